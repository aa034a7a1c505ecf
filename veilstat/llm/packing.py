"""Packing of documents into training sequences by multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm.bpe import default_vocabulary, encoder
from veilstat.llm.common import text_batches

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long, sequence_tokens long, padded_tokens long"
)
_NAMES = [part.split()[0] for part in SCHEMA.split(",")]
_SUM = itemgetter(0)


def differencing(sizes: Sequence[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: items dealt to ``windows`` sets of nearly equal sums.

    Every item starts as a partial partition (its size; all other sets empty,
    and not written down).  The two partial partitions with the widest spread
    are merged, the largest sum of one with the smallest of the other, until
    one is left.  Ties are broken by age, so equal input gives equal output.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    heap = [
        (-sizes[i] if windows > 1 else 0, age, [(sizes[i], i)]) for age, i in enumerate(order)
    ]
    heapq.heapify(heap)
    age = len(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        filled = len(one)
        for j, (size, items) in enumerate(two):
            i = windows - 1 - j
            if i < filled:
                one[i] = (one[i][0] + size, (one[i][1], items))
            else:
                one.append((size, items))
        one.sort(key=_SUM, reverse=True)
        spread = one[0][0] - (one[-1][0] if len(one) == windows else 0)
        heapq.heappush(heap, (-spread, age, one))
        age += 1
    out = []
    for _, top in heap[0][2] if heap else []:
        todo, items = [top], []
        while todo:
            at = todo.pop()
            if isinstance(at, tuple):
                todo.extend(at)
            else:
                items.append(at)
        out.append(sorted(items))
    return out


def fit(sizes, capacity: int) -> list[list[int]]:
    """Sets of items within the capacity: the fewest windows that differencing fills."""
    windows = max(1, -(-int(sum(sizes)) // capacity))
    while True:
        sets = differencing(sizes, windows)
        if all(sum(sizes[i] for i in items) <= capacity for items in sets):
            return [items for items in sets if items]
        windows += 1


class _Packer:
    """Deals the pieces of one task to sequences; holds one group of pieces at most."""

    def __init__(self, base: int, capacity: int, piece: int, windows: int, slack: int):
        self.next, self.capacity, self.piece = base, capacity, piece
        self.target = windows * (capacity - slack)
        self.open: list[tuple] = []
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        ids = ids.astype("<u4")
        while total - start >= self.capacity:
            self._emit([self._piece(doc_id, ids, start, self.capacity, total)])
            start += self.capacity
        while start < total:
            length = min(self.piece, total - start, self.target - self.filled)
            self.open.append(self._piece(doc_id, ids, start, length, total))
            self.filled += length
            start += length
            if self.filled == self.target:
                self.close()

    def close(self) -> None:
        """Packs the pieces gathered so far."""
        for items in fit([p[2] for p in self.open], self.capacity) if self.open else []:
            self._emit([self.open[i] for i in items])
        self.open, self.filled = [], 0

    @staticmethod
    def _piece(doc_id, ids, start, length, total) -> tuple:
        return doc_id, start, length, zlib.crc32(ids[start : start + length]), total

    def _emit(self, pieces: list[tuple]) -> None:
        used = sum(p[2] for p in pieces)
        padded = used if used & (used - 1) == 0 else self.capacity
        offset = 0
        for piece in pieces:
            self.rows.append((*piece, self.next, offset, used, padded))
            offset += piece[2]
        self.next += 1

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in _NAMES]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)
        self.rows = []
        return batch


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    vocabulary: str | None = None,
    end_id: int = 0,
    piece: int = 128,
    windows: int = 64,
    slack: int = 8,
) -> DataFrame:
    """Sequences of at most ``capacity`` ids; one row per piece of a document.

    A document's ids are those of its text (null or empty: none) and ``end_id``.
    Whole stretches of ``capacity`` ids are sequences of their own.  What is left
    of a document is cut into pieces of at most ``piece`` ids; a task gathers
    pieces for ``windows`` sequences, less ``slack`` ids each, and deals them by
    differencing; one window more whenever one would overflow.  A task holds one
    such group, rows are neither shuffled nor dropped, and a lost task yields the
    same sequences again: ``sequence_id`` is its partition and a count.

    Rows with equal or null ``doc_id`` are documents of their own.  Sequences are
    padded to ``capacity``, except those whose length is a power of two.
    Columns other than ``doc_id`` and ``text`` are ignored.  An empty table gives
    an empty result.
    """
    vocabulary = vocabulary or default_vocabulary()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        packer = _Packer(TaskContext.get().partitionId() << 33, capacity, piece, windows, slack)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                packer.add(doc_id.as_py(), encode(text.as_py(), end_id))
                if len(packer.rows) >= 8192:
                    yield packer.take()
        packer.close()
        yield packer.take()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text_batches(rows).mapInArrow(deal, SCHEMA)
