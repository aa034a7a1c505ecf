"""Scores of texts: prediction by partial matching over bytes, and a word baseline."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm.common import remainder, text_batches, written

#: Bytes of context.
ORDER = 5
#: Bytes that never occur in UTF-8: before the first byte of a text, and its end.
BEFORE, END = 0xFE, 0xFF
#: Text bytes that a worker handles at once.
PORTION = 2 << 20
#: Distinct (context, byte) pairs of one slice of the trie; a slice is broadcast.
SLICE_GRAMS = 2_500_000
#: Pairs that a worker counts before it sends them on.
PAIRS_HELD = 1_200_000
#: Words, and bytes of words, that are broadcast with their counts; the rest is joined.
HEAD_WORDS, HEAD_BYTES = 200_000, 8 << 20
#: Distinct words that a worker counts before it sends them on.
WORDS_HELD = 250_000


def grams(texts: list[bytes]) -> np.ndarray:
    """For every byte of the texts and each end: the ``ORDER`` bytes before it, and itself."""
    edge = bytes([END]) + bytes([BEFORE]) * ORDER
    data = np.frombuffer(bytes([BEFORE]) * ORDER + edge.join(texts) + bytes([END]), np.uint8)
    out = np.zeros(len(data) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        out <<= np.uint64(8)
        out |= data[i : i + len(out)]
    return out[data[ORDER:] != BEFORE]


def _masked(pairs: np.ndarray, order: int) -> np.ndarray:
    return pairs & np.uint64((1 << 8 * (order + 1)) - 1)


class Level:
    """The trie at one depth: contexts of ``order`` bytes, and the bytes seen after each."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, self.counts = pairs, counts
        self.contexts, self.start = np.unique(pairs >> np.uint64(8), return_index=True)
        self.total = np.add.reduceat(counts, self.start) if len(pairs) else counts
        self.kinds = np.diff(np.append(self.start, len(pairs)))

    def context(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.contexts, wanted)

    def pair(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.pairs, wanted)


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted values in a sorted array, and which are there."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    start = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else order
    return pairs[start], np.add.reduceat(counts, start) if len(pairs) else counts


class Trie:
    """Log10 probability of a byte after its context, with escapes and exclusion.

    Built from pairs of a context and a byte, in order, and their counts.

    At the longest context that was seen, a byte seen after it n times has n of
    total + kinds shares; the other kinds' shares are the escape to the context
    one byte shorter, where bytes already ruled out above are left out of the
    sums.  Below the empty context all bytes not ruled out are equal.  All
    bytes seen after a context are seen after its shorter ones, so what is ruled
    out depends on the context above alone and is summed once per context.
    """

    def __init__(self, pairs, counts, short_pairs, short_counts):
        levels = {ORDER: Level(pairs, counts)}
        for k in range(ORDER - 1, 1, -1):
            upper = levels[k + 1]
            levels[k] = Level(*_summed(_masked(upper.pairs, k), upper.counts))
        levels[1] = Level(short_pairs, short_counts)
        levels[0] = Level(*_summed(_masked(levels[1].pairs, 0), levels[1].counts))
        self.levels = levels
        self.ruled_out = {}
        for k in range(ORDER):
            upper, lower = levels[k + 1], levels[k]
            shares = lower.counts[np.searchsorted(lower.pairs, _masked(upper.pairs, k))]
            self.ruled_out[k] = np.add.reduceat(shares, upper.start) if len(shares) else shares
        top = levels[ORDER]
        owner = np.repeat(np.arange(len(top.contexts)), top.kinds)
        self.known = np.log10(top.counts / (top.total + top.kinds)[owner])
        self._hash_pairs(top.pairs)

    def _hash_pairs(self, pairs: np.ndarray) -> None:
        """An open table over the longest pairs: most bytes are found at the first look."""
        self.bits = max(10, int(2 * len(pairs)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(pairs), dtype=np.int32), self._place(pairs)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = pairs * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def logs(self, wanted: np.ndarray) -> np.ndarray:
        """Log10 probability of each (context, byte)."""
        out = np.zeros(len(wanted))
        pairs = self.levels[ORDER].pairs
        left, at = np.arange(len(wanted)), self._place(wanted)
        unknown = []
        while len(left):
            slot = self.slot[at]
            gone = slot < 0
            same = ~gone
            same[same] = pairs[slot[same]] == wanted[left[same]]
            out[left[same]] = self.known[slot[same]]
            unknown.append(left[gone])
            on = ~(gone | same)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        left = np.concatenate(unknown) if unknown else left
        out[left] = self._escaped(wanted[left])
        return out

    def _escaped(self, wanted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(wanted))
        left = np.arange(len(wanted))
        for k in range(ORDER, -1, -1):
            level, here = self.levels[k], _masked(wanted[left], k)
            if not len(level.pairs):
                continue
            at, has = level.context(here >> np.uint64(8))
            total = np.where(has, level.total[at], 0)
            kinds = np.where(has, level.kinds[at], 0)
            if k < ORDER and len(self.levels[k + 1].pairs):
                upper, above = self.levels[k + 1], _masked(wanted[left], k + 1)
                at, has = upper.context(above >> np.uint64(8))
                total = total - np.where(has, self.ruled_out[k][at], 0)
                kinds = kinds - np.where(has, upper.kinds[at], 0)
            at, seen = level.pair(here)
            shares = total + kinds
            out[left[seen]] += np.log10(level.counts[at[seen]] / shares[seen])
            escape = ~seen & (kinds > 0)
            out[left[escape]] += np.log10(kinds[escape] / shares[escape])
            left = left[~seen]
        spare = 256 - (int(self.levels[0].kinds[0]) if len(self.levels[0].pairs) else 0)
        out[left] -= np.log10(max(1, spare))
        return out

    def score(self, texts: list[bytes], part: int = 0, parts: int = 1) -> np.ndarray:
        """Log10 probability of each text with its end, over the contexts of one slice."""
        sizes = np.array([len(t) + 1 for t in texts])
        wanted = grams(texts)
        if parts == 1:
            logs = self.logs(wanted)
        else:
            logs = np.zeros(len(wanted))
            here = np.flatnonzero(slice_of(wanted, parts) == part)
            logs[here] = self.logs(wanted[here])
        return np.add.reduceat(logs, np.cumsum(sizes) - sizes)


def slice_of(pairs, parts: int):
    """Contexts of two or more bytes are dealt out by their last two."""
    return ((pairs >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(parts)


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Row numbers and lower-cased texts (null: empty), a few million bytes at a time."""
    rows, texts, size = [], [], 0
    for i, text in enumerate(batch.column(column)):
        raw = (text.as_py() or "").encode().lower()
        rows.append(i)
        texts.append(raw)
        size += len(raw)
        if size >= PORTION:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def count_grams(texts: DataFrame) -> DataFrame:
    """(pair, n): how often each byte follows each context of ``ORDER`` bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            held[:] = [_summed(*(np.concatenate(x) for x in zip(*held)))]

        def flush() -> pa.RecordBatch:
            merge()
            pairs, n = held.pop()
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"]
            )

        for batch in batches:
            for _, part in _portions(batch, 0):
                held.append(np.unique(grams(part), return_counts=True))
                if sum(len(p) for p, _ in held) > 1.5 * PAIRS_HELD:
                    merge()
                    if len(held[0][0]) > PAIRS_HELD:
                        yield flush()
        if held:
            yield flush()

    found = text_batches(texts.select("text")).mapInArrow(count, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): words between ASCII white space, lower-cased."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "n"])

        for batch in batches:
            for _, part in _portions(batch, 0):
                for text in part:
                    held.update(text.split())
                    if len(held) > WORDS_HELD:
                        yield flush()
        if held:
            yield flush()

    found = text_batches(texts.select("text")).mapInArrow(count, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _head(words: DataFrame, most: int) -> DataFrame:
    """The commonest words, at most ``most``: all above a count read off a histogram.

    Counts are sorted into bins of sixteen to a doubling, so the driver sees a
    few hundred rows and no task sorts words.
    """
    brief = words.filter(F.octet_length("word") <= HEAD_BYTES // most)
    bin_no = F.floor(F.log2("n") * 16).alias("bin")
    bins = sorted(brief.groupBy(bin_no).agg(F.count("*").alias("w")).collect(), reverse=True)
    least, held = None, 0
    for row in bins:
        held += row["w"]
        if held > most:
            break
        least = row["bin"]
    return brief.filter(F.floor(F.log2("n") * 16) >= least) if least is not None else brief.limit(0)


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, and their counts."""
    got = df.toArrow()
    pairs, counts = got.column(0).to_numpy().astype(np.uint64), got.column(1).to_numpy()
    order = np.argsort(pairs)
    return pairs[order], counts[order]


def score(docs: DataFrame, divisor: int = 7, held: int = 2, slice_grams: int = SLICE_GRAMS,
          head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per document: its log10 probability by the trie, and by single words.

    Both models learn from the texts whose crc32(doc_id) mod ``divisor`` is not
    ``held`` (a null ``doc_id`` is learnt from), with A-Z lower-cased; null texts
    are empty.  ``score`` is the trie's log10 probability of the bytes and the end
    of the text.  ``base_score`` sums log10((c + 1) / (N + V + 1)) over its words
    and one end: c a token's count in training, N all tokens, V distinct ones.

    The trie is dealt to slices of ``slice_grams`` pairs by the last two bytes of
    the context, each broadcast and passed over the texts; a trie below that size
    is one slice.  Common words are broadcast up to a fixed number and size; each
    document's other words are joined with the table of counts.  Rows with equal
    ids are scored each; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    left_out = F.coalesce(remainder("doc_id", divisor) == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), left_out.alias("held_out"))
    train = rows.filter("not held_out")

    pairs = written(count_grams(train), "grams")
    words = written(count_words(train), "words")
    n_pairs = pairs.count()
    parts = max(1, -(-n_pairs // slice_grams))
    low = F.col("pair").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("low")
    short = _arrays(pairs.groupBy(low).agg(F.sum("n").alias("n")))
    totals = words.agg(F.sum("n"), F.count("*")).first()
    n_texts = train.count()
    all_tokens = int(totals[0] or 0) + n_texts
    kinds = int(totals[1]) + (1 if n_texts else 0)
    each_token = float(np.log10(all_tokens + kinds + 1))
    end_log, end_known = float(np.log10(n_texts + 1)), int(n_texts > 0)

    top = _head(words, head_words).toArrow()
    head = spark.sparkContext.broadcast(
        dict(zip(top.column(0).to_pylist(), np.log10(top.column(1).to_numpy() + 1.0).tolist()))
    )

    def slice_trie(part: int):
        chosen = pairs
        if parts > 1:
            two = F.shiftright("pair", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))
            chosen = pairs.filter(two % parts == part)
        return spark.sparkContext.broadcast((*_arrays(chosen), *short))

    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rest"]
    schema = (
        "row long, doc_id long, held_out boolean, n_tokens long, known long, base double,"
        " score double, rest array<struct<word:binary, n:int>>"
    )
    kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
    first = slice_trie(0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, logs = _cached(first), head.value
        for batch in batches:
            for at, texts in _portions(batch, 2):
                scores = trie.score(texts, 0, parts)
                n_tokens, known, base, rest = [], [], [], []
                for text in texts:
                    tokens = text.split()
                    found = [logs.get(w) for w in tokens]
                    other = Counter([w for w, x in zip(tokens, found) if x is None])
                    missing = other.total()
                    n_tokens.append(len(tokens) + 1)
                    known.append(len(tokens) - missing + end_known)
                    base.append(sum(x for x in found if x is not None) + end_log)
                    rest.append([{"word": w, "n": n} for w, n in other.items()])
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(3),
                        pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()), pa.array(scores, pa.float64()),
                        pa.array(rest, kind),
                    ],
                    names=names,
                )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    scored = written(text_batches(numbered).mapInArrow(each, schema), "scored")

    rest = scored.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.n")
    counts = words.select("word", F.col("n").alias("c"))
    sums = rest.join(counts, "word").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_base"),
        F.sum("n").alias("more_known"),
    )
    result = scored.drop("rest").join(sums, "row", "left")
    total = F.col("score")
    for part in range(1, parts):
        # Later slices read the texts again; rows keep their numbers, as the plan is the same.
        sent = slice_trie(part)
        result = result.join(_slice_scores(numbered, sent, part, parts), "row")
        total = total + F.col(f"score_{part}")
    zero = F.lit(0)
    return result.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (
            F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * each_token
        ).alias("base_score"),
        total.alias("score"),
    )


def _slice_scores(numbered: DataFrame, sent, part: int, parts: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _cached(sent)
        for batch in batches:
            for at, texts in _portions(batch, 2):
                scores = trie.score(texts, part, parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(scores)],
                    names=["row", f"score_{part}"],
                )

    return numbered.mapInArrow(each, f"row long, score_{part} double")


_TRIES: dict[int, Trie] = {}


def _cached(sent) -> Trie:
    """The trie of a broadcast, built once per Python worker; one is held at a time."""
    key = sent._jbid if hasattr(sent, "_jbid") else id(sent)
    key = getattr(sent, "_path", key)
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = Trie(*sent.value)
    return _TRIES[key]
