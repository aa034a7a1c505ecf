"""Benchmark passages in documents: q-gram lemma filter, banded alignment."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm.common import text_batches

#: Characters of a q-gram.
Q = 8
#: Share of an item's characters that may be edited.
EDITS = 0.1
#: Words of the windows that are searched of longer items, and words between their beginnings.
WINDOW, STEP = 50, 25
#: Places of shared q-grams that are counted at once.
ENTRIES = 1 << 22
#: Characters of benchmark items that one pass over the documents takes along.
BLOCK_CHARS = 4_000_000
#: Characters of documents that a worker searches at once.
PORTION = 1 << 18
_BITS = 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def normal(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters as one space."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _kept()[codes]
    codes = np.where(kept, codes, 32)
    if len(codes):
        first = np.append(True, kept[:-1])
        codes = codes[kept | first]
    start = 1 if len(codes) and codes[0] == 32 else 0
    stop = len(codes) - 1 if len(codes) > start and codes[-1] == 32 else len(codes)
    return codes[start:stop]


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the ``Q`` characters from each place on (as many places as there are)."""
    with np.errstate(over="ignore"):
        out, width, factor = codes.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x100000001B3)
        while width < Q:
            out = out[:-width] * factor + out[width:] if len(out) > width else out[:0]
            width, factor = 2 * width, factor * factor
    return out


def _windows(codes: np.ndarray) -> list[np.ndarray]:
    """Overlapping windows of an item of more than ``WINDOW`` words, the last up to its end."""
    starts = np.append(0, np.flatnonzero(codes == 32) + 1)
    stops = np.append(starts[1:] - 1, len(codes))
    last = len(starts) - WINDOW
    if last <= 0:
        return []
    return [codes[starts[i] : stops[i + WINDOW - 1]] for i in sorted({*range(0, last, STEP), last})]


def _word_hashes(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(starts), np.uint64)
        for i in range(length):
            out = (out + codes[starts + i].astype(np.uint64) + np.uint64(1)) * _SPREAD
    return out


class Items:
    """Benchmark items of one block: long ones and their windows by q-gram, short ones by hash.

    Entries are numbered, the long ones first; ``owners`` has the item of each
    and ``whole`` whether it is the item or a window of it.
    """

    def __init__(self, items: list[tuple[int | None, str]], edits: float = EDITS):
        self.ids = [k for k, _ in items]
        texts = [normal(t) for _, t in items]
        found = [(n, True, c) for n, c in enumerate(texts) if len(c) >= Q]
        found += [(n, False, c) for n, _, codes in found for c in _windows(codes)]
        short = [(n, c) for n, c in enumerate(texts) if 0 < len(c) < Q]
        self.owners = [n for n, _, _ in found] + [n for n, _ in short]
        self.whole = [w for _, w, _ in found] + [True] * len(short)
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for entry, (_, c) in enumerate(short, len(found)):
            self.short.setdefault(len(c), {}).setdefault(c.astype(np.uint32).tobytes(), []).append(entry)
        self.short_hashes = {}
        for length, known in self.short.items():
            rows = [np.frombuffer(k, np.uint32) for k in known]
            hashes = [_word_hashes(r, np.zeros(1, np.int64), length)[0] for r in rows]
            self.short_hashes[length] = np.array(hashes, np.uint64)
        self.codes = [c for _, _, c in found]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        # An edit spoils Q q-grams at most; the budget leaves one at least to be shared.
        self.edits = np.minimum((edits * self.size).astype(np.int64), (self.size - Q) // Q)
        self.need = self.size - Q + 1 - Q * self.edits
        owner = np.repeat(np.arange(len(found)), self.size - Q + 1)
        place = [np.arange(n) for n in self.size - Q + 1]
        hashes = [_hashes(c) for c in self.codes]
        if found:
            hashes, place = np.concatenate(hashes), np.concatenate(place)
        else:
            hashes, place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.start = np.unique(hashes[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(order)))
        self.marks = np.zeros(1 << _BITS, bool)
        self.marks[self._mark(self.grams)] = True
        self.margin = int((self.size + 4 * (self.edits + 1)).max(initial=0))

    @staticmethod
    def _mark(hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (hashes * _SPREAD) >> np.uint64(64 - _BITS)

    def regions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) whose shared q-grams meet the item's bound.

        A q-gram shared by place p of the text and place i of an item lies on
        diagonal p - i.  An alignment with e edits stays within e + 1
        neighbouring diagonals, so it lies whole in one of the bands of 2(e + 1)
        diagonals that begin at every multiple of e + 1.
        """
        hashes = _hashes(codes)
        at = np.flatnonzero(self.marks[self._mark(hashes)])
        if not len(at) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gram = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        same = self.grams[gram] == hashes[at]
        at, gram = at[same], gram[same]
        wide = len(codes) + self.margin + 2
        # A q-gram that many items share has many places: they are counted a portion at a time.
        portion = np.cumsum(self.count[gram]) // ENTRIES
        cuts = np.append(np.flatnonzero(np.diff(portion, prepend=-1)), len(at))
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for low, high in zip(cuts[:-1], cuts[1:]):
            some, m = np.unique(self._bands(at[low:high], gram[low:high], wide), return_counts=True)
            if len(keys):
                keys, where = np.unique(np.concatenate([keys, some]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n, m]), len(keys)).astype(np.int64)
            else:
                keys, n = some, m
        item, band = keys // (2 * wide), keys % (2 * wide) - wide
        enough = n >= self.need[item]
        return item[enough], band[enough]

    def _bands(self, at: np.ndarray, gram: np.ndarray, wide: int) -> np.ndarray:
        """(item, band) as one number, for each place of a shared q-gram the two bands it lies in."""
        times = self.count[gram]
        entry = np.repeat(self.start[gram] - (np.cumsum(times) - times), times)
        entry += np.arange(len(entry))
        item = self.owner[entry]
        band = (np.repeat(at, times) - self.place[entry]) // (self.edits[item] + 1)
        key = item * (2 * wide) + band + wide
        return np.concatenate([key, key - 1])

    def words(self, codes: np.ndarray) -> list[int]:
        """Entries of the short items that stand in the text as whole words."""
        found: list[int] = []
        if not self.short or not len(codes):
            return found
        starts = np.append(0, np.flatnonzero(codes == 32) + 1)
        ended = np.append(codes == 32, True)
        for length, known in self.short.items():
            fit = starts[starts + length <= len(codes)]
            fit = fit[ended[fit + length]]
            fit = fit[np.isin(_word_hashes(codes, fit, length), self.short_hashes[length])]
            for text in {codes[i : i + length].astype(np.uint32).tobytes() for i in fit.tolist()}:
                found += known.get(text, [])
        return found

    def best(self, found: dict[int, int]) -> list[tuple[int | None, int, bool]]:
        """(id, edits, whole) of each item found: of the whole if that is there, else of its best window."""
        least: dict[int, tuple[bool, int]] = {}
        for entry, edits in found.items():
            new = (not self.whole[entry], edits)
            least[self.owners[entry]] = min(new, least.get(self.owners[entry], new))
        return [(self.ids[n], edits, not part) for n, (part, edits) in least.items()]

    def align(self, codes, item, band, low, high) -> np.ndarray:
        """Least edits of each item against any stretch of codes[low:high] in its band."""
        step = self.edits[item] + 1
        width, longest = int(2 * step.max()), int(self.size[item].max())
        letters = np.zeros((len(item), longest), np.uint32)
        for row, k in enumerate(item):
            letters[row, : self.size[k]] = self.codes[k]
        begin, far = band * step, 1 << 20
        offset = np.arange(width)
        outside = offset[None, :] >= 2 * step[:, None]
        # A path may start at any place from ``low`` to ``high``, and end there.
        cost = np.zeros(outside.shape, np.int64)
        best = np.full(len(item), far)
        low, high = low[:, None], high[:, None]
        for i in range(longest + 1):
            place = (begin + i)[:, None] + offset
            barred = outside | (place < low) | (place > high)
            if i:
                # ``place`` characters of the text lie before; the one just read is place - 1.
                text = codes[np.clip(place - 1, 0, len(codes) - 1)]
                apart = (text != letters[:, i - 1 : i]) | (place <= low)
                skipped = np.append(cost[:, 1:], np.full((len(item), 1), far), axis=1) + 1
                cost = np.minimum(cost + np.where(place <= low, far, apart), skipped)
            cost[barred] = far
            if i:
                cost = np.minimum.accumulate(cost - offset, axis=1) + offset
                cost[barred] = far
            done = self.size[item] == i
            best[done] = cost[done].min(axis=1)
        return best

    def search_many(self, texts: list[np.ndarray]) -> list[dict[int, int]]:
        """Per text: item number -> edits, for the items it holds within their budget.

        The texts are joined by a character that no item holds.
        """
        out: list[dict[int, int]] = [{} for _ in texts]
        gap = np.zeros(1, np.uint32)
        joined = np.concatenate([x for t in texts for x in (t, gap)])
        stops = np.cumsum([len(t) + 1 for t in texts])
        item, band = self.regions(joined)
        # A band may reach into two texts; it is aligned with each that it touches.
        begin = band * (self.edits[item] + 1)
        first = np.searchsorted(stops, np.maximum(begin, 0), side="right")
        last_place = begin + 2 * (self.edits[item] + 1) + self.size[item]
        last = np.searchsorted(stops, np.minimum(last_place, stops[-1] - 1), side="right")
        for shift in range(int((last - first).max(initial=-1)) + 1):
            use = first + shift <= last
            for i in range(0, int(use.sum()), 256):
                few, where = item[use][i : i + 256], band[use][i : i + 256]
                owner = (first + shift)[use][i : i + 256]
                lows = np.append(0, stops)[owner]
                found = self.align(joined, few, where, lows, stops[owner] - 1)
                for k, o, edits in zip(few.tolist(), owner.tolist(), found.tolist()):
                    if edits <= self.edits[k] and edits < out[o].get(k, 1 << 20):
                        out[o][k] = edits
        return out


def _stretches(codes: np.ndarray, overlap: int) -> Iterator[np.ndarray]:
    """A long text in stretches; any passage of ``overlap`` characters is whole in one."""
    at = 0
    while True:
        yield codes[at : at + PORTION + overlap]
        at += PORTION
        if at + overlap >= len(codes):
            return


def _search_batch(items: Items, texts: pa.Array) -> list[dict[int, int]]:
    out: list[dict[int, int]] = [{} for _ in range(len(texts))]
    held, owners, size = [], [], 0

    def flush() -> None:
        for owner, found in zip(owners, items.search_many(held)):
            for k, edits in found.items():
                out[owner][k] = min(edits, out[owner].get(k, edits))

    for i, text in enumerate(texts):
        codes = normal(text.as_py())
        out[i].update(dict.fromkeys(items.words(codes), 0))
        for part in _stretches(codes, items.margin):
            if len(part) < Q:
                continue
            held.append(part)
            owners.append(i)
            size += len(part)
            if size >= PORTION:
                flush()
                held, owners, size = [], [], 0
    if held:
        flush()
    return out


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Distinct benchmark items in blocks of about ``block_chars`` characters."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    for number in range(blocks):
        one = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number)
        rows = sorted(one.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield [(r[0], r[1]) for r in rows]


_ITEMS: dict = {}


def _cached(sent, edits: float) -> Items:
    """The index of a broadcast block, built once per Python worker; one is held at a time."""
    key = (sent.value[0], edits)
    if key not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[key] = Items(sent.value[1], edits)
    return _ITEMS[key]


def _send(spark, rows: list):
    """A block as a broadcast, with a name that tells it from others in a worker."""
    return spark.sparkContext.broadcast((hash(tuple(rows)), rows))


def find(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, whole): the benchmark items that a document holds.

    An item is held if some stretch of the document differs from it by at most
    ``edits`` of the item's characters, both lower-cased and with runs of other
    characters than letters and digits as one space.  Stretches that share too
    few q-grams for that are left out by the q-gram lemma, the others aligned.

    Of an item of more than 50 words, windows of 50 words that begin at every
    25th are searched too, each with its own budget: any 74 of its words in a row
    hold a window.  ``whole`` tells whether the item is there; if not, ``edits``
    are those of its best window.  Items shorter than 8 characters are held where
    they stand as whole words, unedited; from there to 80 characters the budget
    shrinks so that one shared q-gram is left.  Null items and those without a
    letter or digit are not searched.

    Null and empty texts hold nothing.  Rows with equal ids are searched each;
    null ids are reported as null.  Benchmark items are taken in
    blocks, each broadcast and passed over all documents; other columns are
    ignored; an empty table on either side gives an empty result.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, edits long, whole boolean"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def one_block(block: list) -> DataFrame:
        sent = _send(spark, block)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _cached(sent, edits)
            for batch in batches:
                hits = [
                    (doc_id.as_py(), *hit)
                    for doc_id, found in zip(batch.column(0), _search_batch(items, batch.column(1)))
                    for hit in items.best(found)
                ]
                columns = [pa.array([h[i] for h in hits], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "edits", "whole"])

        return text_batches(rows).mapInArrow(each, schema)

    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, block_chars):
        out = out.union(one_block(block))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, as ``find`` has it."""
    spark, place = docs.sparkSession, docs.columns.index("text")
    for block in _blocks(benchmark, block_chars):
        sent = _send(spark, block)

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = _cached(sent, edits)
            for batch in batches:
                clean = [not found for found in _search_batch(items, batch.column(place))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = text_batches(docs).mapInArrow(each, docs.schema)
    return docs
