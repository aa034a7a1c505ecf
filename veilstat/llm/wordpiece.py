"""Token counts by a linear longest-match automaton: lengths without the pieces."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm.bpe import default_vocabulary
from veilstat.llm.common import text_batches

#: Words whose length a worker remembers; later ones are measured anew each time.
REMEMBERED = 500_000


class Automaton:
    """Greedy word-piece lengths in one pass over a word's bytes.

    Two tries hold the pieces that begin a word and those that continue one.
    Where a node has no step for the next byte, its failure link leads to the
    node of what is left once the longest matches are taken off, and a number
    tells how many pieces that takes off.  So no byte is read twice.
    """

    def __init__(self, initial: Iterable[bytes], continuation: Iterable[bytes]):
        self.step: dict[int, int] = {}
        parents, piece = [(-1, 0), (-1, 0)], [False, False]
        for root, pieces in enumerate((initial, continuation)):
            for text in pieces:
                at = root
                for byte in text:
                    to = self.step.get(at << 8 | byte)
                    if to is None:
                        to = self.step[at << 8 | byte] = len(parents)
                        parents.append((at, byte))
                        piece.append(False)
                    at = to
                if at > 1:
                    piece[at] = True
        self.fail, self.popped = [-1] * len(parents), [0] * len(parents)
        depth = [0] * len(parents)
        for v in range(2, len(parents)):
            depth[v] = depth[parents[v][0]] + 1
        for v in sorted(range(2, len(parents)), key=depth.__getitem__):
            if piece[v]:
                self.fail[v], self.popped[v] = 1, 1
                continue
            u, byte = parents[v]
            z, n = self.fail[u], self.popped[u]
            while z >= 0 and z << 8 | byte not in self.step:
                z, n = self.fail[z], n + self.popped[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.step[z << 8 | byte], n

    def length(self, word: bytes) -> int:
        """Pieces of a word; 1 for a word that cannot be put together, 0 for none."""
        step, fail, popped = self.step, self.fail, self.popped
        at = n = 0
        for byte in word:
            while (to := step.get(at << 8 | byte)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at > 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


def pieces_of(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces from a byte-level vocabulary file: with a leading space, and without."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    texts = [bytes(byte[c] for c in t) for t in vocabulary if all(c in byte for c in t)]
    return [t for t in texts if t[:1] == b" "], [t for t in texts if t[:1] != b" "]


class _Lengths(dict):
    """Word -> its number of pieces, measured when first met."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.length(b" " + word)
        if len(self) < REMEMBERED:
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def lengths(path: str) -> _Lengths:
    """One table of lengths per Python worker and file."""
    return _Lengths(Automaton(*pieces_of(path)))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens): greedy word-piece lengths of whole texts.

    Words are runs of bytes other than ASCII white space, each with a space in
    front; the pieces that begin with a space start a word, the others continue
    it, and the longest match is taken each time.  Null, empty and blank texts
    have no words and no tokens.  Rows with equal or null ``doc_id`` are counted
    each; columns other than ``doc_id`` and ``text`` are ignored; an empty table
    gives an empty result.
    """
    vocabulary = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = lengths(vocabulary).__getitem__
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").encode().split()
                words.append(len(found))
                tokens.append(sum(map(length, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text_batches(rows).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
