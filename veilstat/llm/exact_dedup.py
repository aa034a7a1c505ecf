"""Exact duplicates: two passes of a Bloom filter find the texts that may occur again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.llm.common import Scratch, text_batches
from veilstat.operators.classes import join_by_class

#: Bits of the filter for each document, and bits that a document sets.
BITS_A_KEY, PROBES = 16, 4
#: Bits of the filter at most: 128 MB, which the driver holds and broadcasts.  Beyond
#: 67 million documents more of the texts that occur once are shuffled, with the same result.
MOST_BITS = 1 << 30
#: Bits that are merged as one row.
SEGMENT_BITS = 1 << 19
#: Documents whose bits are told apart before they move.
CHUNK = 1 << 16


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, sha): SHA-256 of each text, A-Z in lower case; null texts are empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            found = [hashlib.sha256((t.as_py() or b"").lower()).digest() for t in texts]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "sha"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return text_batches(rows).mapInArrow(each, "row long, doc_id long, sha binary")


def _spots(shas: pa.Array, bits: int) -> np.ndarray:
    """The bits of each digest, a row of ``PROBES`` for each; ``bits`` is a power of two."""
    words = np.frombuffer(b"".join(s.as_py() for s in shas), np.uint64).reshape(-1, 4)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (words[:, :1] + steps * (words[:, 1:2] | np.uint64(1))) & np.uint64(bits - 1)


def _several(shas: DataFrame, bits: int) -> DataFrame:
    """(segment, bitmap): the bits that two rows at least have set."""
    segment_bits, chunk = min(bits, SEGMENT_BITS), CHUNK
    shift = segment_bits.bit_length() - 1

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            # Equal texts set equal bits: two of each are enough to tell.
            different, times = np.unique(np.concatenate(held), axis=0, return_counts=True)
            spots = np.sort(np.concatenate([different, different[times > 1]]).ravel())
            segments, starts = np.unique(spots >> np.uint64(shift), return_index=True)
            parts = np.split((spots & np.uint64(segment_bits - 1)).astype(np.uint32), starts[1:])
            columns = [pa.array(segments.astype(np.int64)), pa.array([p.tobytes() for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "spots"])

        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_spots(batch.column(0), bits))
                count += batch.num_rows
            if count >= chunk:
                yield from out(held)
                held, count = [], 0
        if held:
            yield from out(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(segment: int, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
            if (seen > 1).any():
                columns = [pa.array([segment], pa.int64()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "bitmap"])

        now, seen = None, None
        for batch in batches:
            for segment, spots in zip(batch.column(0).to_pylist(), batch.column(1)):
                if segment != now:
                    if now is not None:
                        yield from out(now, seen)
                    now, seen = segment, np.zeros(segment_bits, np.uint8)
                at, times = np.unique(np.frombuffer(spots.as_py(), np.uint32), return_counts=True)
                seen[at] = np.minimum(seen[at] + np.minimum(times, 2), 2)
        if now is not None:
            yield from out(now, seen)

    marked = shas.mapInArrow(mark, "segment long, spots binary")
    dealt = marked.repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(merge, "segment long, bitmap binary")


def possibly_repeated(spark: SparkSession, rows: DataFrame, count: int, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` (row, doc_id, sha) with ``maybe``: false only where no other row has this digest.

    The first pass tells of each bit whether none, one or several rows set it,
    the second takes the rows all of whose bits were set by several.
    """
    bits = 1 << max(10, min(BITS_A_KEY * count, most_bits).bit_length() - 1)
    segment_bytes = min(bits, SEGMENT_BITS) // 8
    bitmap = np.zeros(bits // 8, np.uint8)
    found = _several(rows.select("sha"), bits).toArrow()
    for segment, part in zip(found.column(0).to_pylist(), found.column(1)):
        at = segment * segment_bytes
        bitmap[at : at + segment_bytes] = np.frombuffer(part.as_py(), np.uint8)
    several = spark.sparkContext.broadcast(bitmap)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                spots = _spots(batch.column("sha"), bits)
                hit = several.value[spots >> np.uint64(3)] >> (np.uint64(7) - (spots & np.uint64(7))).astype(np.uint8)
                yield batch.append_column("maybe", pa.array((hit & 1).all(axis=1)))

    return rows.mapInArrow(probe, "row long, doc_id long, sha binary, maybe boolean")


def exact_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per document.

    Texts are read once, into digests.  Of those only the ones that the filter
    takes for repeated are shuffled; groups that hold many rows meet a broadcast
    instead.  Null texts are empty, and equal to empty ones.  Of equal texts the
    row with the largest ``doc_id`` stays, a null one only if there is no other;
    of rows that agree in both, the last in reading order.  Columns other than
    ``doc_id`` and ``text`` are ignored.  An empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = scratch.put(digests(docs), "digests")
    rows = scratch.put(possibly_repeated(spark, rows, rows.count(), most_bits), "probed")
    scratch.drop("digests")

    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = rows.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    again = rows.filter("maybe").select("row", "doc_id", "sha")
    groups = again.groupBy("sha").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best")
    )
    joined = join_by_class(again, scratch.put(groups, "groups"), ["sha"], "group_size")
    kept = (F.col("row") == F.col("best.row")).alias("kept")
    return alone.unionByName(joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept, sha))
