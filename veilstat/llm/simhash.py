"""SimHash near-duplicates: fingerprints, links within two bits, groups of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veilstat.llm.common import Scratch, text_batches, written

#: Segments of a fingerprint; each has 64 / SEGMENTS = 4 bits, so a count fits four bits.
SEGMENTS = 16
#: Cells with more fingerprints than this are linked through shared one-bit changes.
CROWDED = 64
#: Ids that are broadcast; more are joined.
BROADCAST_IDS = 1_000_000
#: Documents, or links, up to which Spark may broadcast a side of a join by its own estimate.
ESTIMATED_ROWS = 250_000
STRETCH = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch at a time."""
    at = 0
    while len(text) - at > STRETCH:
        found = _SPACE.search(text, at + STRETCH)
        if not found:
            break
        yield text[at : found.start()].split()
        at = found.end()
    yield text[at:].split()


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text: bit i is set if it is in over half the shingles' hashes.

    Shingles count as often as they occur.  A text with fewer words than a
    shingle is one shingle; one without words (or null) has fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    held: list[bytes] = []
    ones, total = np.zeros(64, np.int64), 0

    def add(shingles: list[bytes]) -> int:
        hashes = np.array([xxh64_intdigest(s, 42) for s in shingles], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        np.add(ones, bits.sum(axis=0, dtype=np.int64), out=ones)
        return len(shingles)

    for part in _word_lists((text or "").encode().lower()):
        held += part
        if len(held) >= words:
            total += add([b" ".join(held[i : i + words]) for i in range(len(held) - words + 1)])
            held = held[len(held) - words + 1 :]
    if not total and held:
        total = add([b" ".join(held)])
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, bits): one fingerprint per document, as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time is held twice.
            marks = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "bits"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text_batches(rows).mapInArrow(each, "doc_id long, bits long")


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def segment_counts(bits: Column) -> Column:
    """The number of set bits of each four-bit segment, sixteen counts in one long."""
    odd = _long(0x5555555555555555)
    left, right = bits.bitwiseAND(odd), F.shiftrightunsigned(bits, 1).bitwiseAND(odd)
    # left + right in two bits each, without a carry into the sign.
    pairs = left.bitwiseXOR(right).bitwiseOR(F.shiftleft(left.bitwiseAND(right), 1))
    three = _long(0x3333333333333333)
    return pairs.bitwiseAND(three) + F.shiftrightunsigned(pairs, 2).bitwiseAND(three)


def _near_cells(counts: Column) -> Column:
    """The cell of a vector of counts and all cells at Manhattan distance one."""
    cells = [counts]
    for segment in range(SEGMENTS):
        step = _long(1 << 4 * segment)
        here = F.shiftrightunsigned(counts, 4 * segment).bitwiseAND(_long(15))
        cells.append(F.when(here < 4, counts + step))
        cells.append(F.when(here > 0, counts - step))
    return F.array_compact(F.array(*cells))


def _sorted_join(side: DataFrame, rows: int | None = None) -> DataFrame:
    """``side`` of a join that sorts both sides, unless there are few ``rows``.

    Spark sizes a side by the files below it: rows that are exploded count as one,
    and what files hold in two bytes takes fifty in a broadcast.
    """
    return side if rows is not None and rows <= ESTIMATED_ROWS else side.hint("merge")


def links(marks: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, that join all fingerprints at ``max_bits`` (0 to 2) or fewer.

    The counts of set bits per segment differ in sum (Manhattan distance) by at
    most the bits that differ.  So two vectors of counts within two of each
    other meet in a cell of the unit grid at distance one or less from both:
    each fingerprint is put into its cell and the cells around it, and those
    that meet are compared bit by bit.

    Crowded cells would give many pairs.  There each fingerprint meets the
    others at its 64 one-bit changes, which is exact for two bits, and is linked
    to the smallest one met: all are still joined, by a number of links in
    proportion to the fingerprints.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits is 0, 1 or 2")
    if max_bits == 0:
        return marks.select(F.col("bits").alias("a"), F.col("bits").alias("b")).limit(0)
    cells = marks.select("bits", F.explode(_near_cells(segment_counts(F.col("bits")))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("met")).filter("met > 1")
    met = written(cells.join(_sorted_join(shared), "cell"), "cells")

    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    few = met.filter(F.col("met") <= CROWDED).groupBy("cell").agg(F.collect_list("bits").alias("m"))
    pairs = F.flatten(
        F.transform(
            "m",
            lambda a: F.transform(
                F.filter("m", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )
    close = few.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    changes = [F.col("bits")] if max_bits == 2 else []
    changes += [F.col("bits").bitwiseXOR(_long(1 << i)) for i in range(64)]
    if max_bits == 1:
        # At one bit the smaller side stands for itself, the other for its changes.
        changes = [F.col("bits"), *changes]
    many = met.filter(F.col("met") > CROWDED).select(
        "bits", "cell", F.explode(F.array(*changes)).alias("at")
    )
    if max_bits == 1:
        many = many.withColumn("own", F.col("bits") == F.col("at"))
        own = many.filter("own").select("cell", "at", F.col("bits").alias("a"))
    else:
        own = many.groupBy("cell", "at").agg(F.min("bits").alias("a"))
    crowd = many.withColumnRenamed("bits", "b").join(_sorted_join(own), ["cell", "at"]).select("a", "b")
    crowd = crowd.filter((F.col("a") < F.col("b")) & (apart <= max_bits))
    return close.union(crowd).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node it reaches.

    Large and small stars by turns: each node's neighbours are tied to the least
    of them, which about halves paths.  Every round is written, so a lost
    executor costs one round at most, and replaces the one before; only two counts reach the driver.
    """

    def outline(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    scratch = Scratch(edges.sparkSession)
    edges = scratch.put(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = outline(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(_sorted_join(least, before[0]), "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        # Now a < b; each b is tied to the least a, and so are its other a.
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(_sorted_join(lowest, before[0]), "b")
        small = joined.select(F.col("m").alias("a"), "b").union(
            joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        )
        edges = scratch.put(small.distinct(), "edges")
        after = outline(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots.distinct())


def _groups(docs: DataFrame, words: int, max_bits: int) -> tuple[DataFrame, DataFrame, int]:
    """Written fingerprints of documents, (bits, root) of each fingerprint, and the documents' number."""
    marks = written(fingerprints(docs, words), "marks")
    rows = marks.count()
    nodes = marks.select("bits").distinct()
    roots = _sorted_join(components(links(nodes, max_bits)), rows)
    nodes = nodes.join(roots, nodes["bits"] == roots["node"], "left")
    return marks, nodes.select("bits", F.coalesce("root", "bits").alias("root")), rows


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): groups of documents linked by fingerprints.

    ``component_id`` is the least ``doc_id`` that is reached over fingerprints
    at ``max_bits`` differing bits or fewer.  Equal fingerprints are one node, so
    copies cost nothing beyond their row.  Null and empty texts have fingerprint
    0 and are linked like any other; rows with equal or null ``doc_id`` keep
    their rows (a group of null ids has a null component).  Columns other than
    ``doc_id`` and ``text`` are ignored.  An empty table gives an empty result.
    """
    marks, nodes, rows = _groups(docs, words, max_bits)
    least = marks.groupBy("bits").agg(F.min("doc_id").alias("least")).join(_sorted_join(nodes, rows), "bits")
    tops = least.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = nodes.join(_sorted_join(tops, rows), "root").select("bits", "component_id")
    labelled = _sorted_join(labelled, rows)
    text = F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")
    return marks.join(labelled, "bits").select("doc_id", text, "component_id")


def _small(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if there are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else _sorted_join(ids)


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each group of ``near_duplicates``: the one with the least id.

    Rows whose id is null or occurs again are told apart by their fingerprints;
    of those that agree in both, the first by text stays.  Texts are not
    shuffled while the ids that go, and those that occur again, fit a broadcast.
    """
    marks, nodes, n = _groups(docs, words, max_bits)
    own = marks.groupBy("bits").agg(F.min("doc_id").alias("doc_id")).join(_sorted_join(nodes, n), "bits")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "bits")
    kept = own.groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.bits")
    kept = _sorted_join(written(kept, "kept"), n)
    counted = marks.groupBy("doc_id").agg(F.count("*").alias("n"))
    again = written(counted.filter("n > 1 or doc_id is null").select("doc_id"), "again")

    dropped = marks.join(kept, ["doc_id", "bits"], "left_anti").select("doc_id")
    gone = written(dropped.union(again).distinct(), "gone").select(F.col("doc_id").alias("key"))
    plain = docs.join(_small(gone), docs["doc_id"].cast("long").eqNullSafe(gone["key"]), "left_anti")
    if again.isEmpty():
        return plain

    several = again.select(F.col("doc_id").alias("key"))
    twice = docs.join(_small(several), docs["doc_id"].cast("long").eqNullSafe(several["key"]), "left_semi")
    names = [f"c{i}" for i in range(len(docs.columns))]
    twice = twice.toDF(*names)
    text, key = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    kinds = StructType([*twice.schema.fields, StructField("bits", LongType())])
    at = docs.columns.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), words) for t in batch.column(at)], np.uint64)
            yield batch.append_column("bits", pa.array(marks.view(np.int64)))

    rows = text_batches(twice).mapInArrow(mark, kinds)
    rows = rows.select(F.col(key).cast("long").alias("id"), "bits", F.struct(*names).alias("row"))
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["doc_id"]) & (rows["bits"] == kept["bits"]), "left_semi")
    rows = rows.groupBy("id", "bits").agg(F.min_by("row", F.struct(f"row.{text}")).alias("row"))
    return plain.union(rows.select("row.*").toDF(*docs.columns))
