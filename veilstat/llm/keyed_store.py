"""Token ids on disk: raw id payloads in shards, found through a minimal perfect hash."""

from __future__ import annotations

import functools
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilstat.llm.bpe import default_vocabulary, encoder
from veilstat.llm.common import text_batches

#: Payload bytes after which a shard is closed; a document is never split.
SHARD_BYTES = 4 << 20
SHARD_SCHEMA = (
    "part long, shard long, part_start long, n_ids long, n_docs long, id_bytes int,"
    " first_key long, last_key long, payload binary, keys binary, nulls binary, ordinals binary,"
    " seed long, levels binary, bits binary, slots binary"
)
SLOT = np.dtype([("print", "<u4"), ("length", "<u4"), ("offset", "<u8")])
_READ = ("part", "part_start", "id_bytes", "payload", "keys", "nulls", "ordinals")
_READ += ("seed", "levels", "bits", "slots")
_C1, _C2, _C3 = (
    np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mix of each value, different for each seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _C1 * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _C2
        x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, nulls: np.ndarray, ordinals: np.ndarray, seed: int) -> np.ndarray:
    """One value per (key, null mark, number among equal keys)."""
    tag = mix(ordinals.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64), seed)
    return mix(keys.view(np.uint64) ^ tag, seed + 1)


class PerfectHash:
    """Levels of bits: a key's bit is set in the first level where no other key has it.

    The number of set bits before it is the key's index, from 0 to n - 1.
    """

    def __init__(self, levels: np.ndarray, bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, hashes: np.ndarray, spare: float = 2.0) -> PerfectHash:
        sizes, words, left = [], [], hashes
        while len(left):
            size = max(64, int(-(-len(left) * spare // 64)) * 64)
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(
            np.array(sizes, "<u4"), np.concatenate(words) if words else np.zeros(0, "<u8")
        )

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each key; -1 where no level has its bit (then it is no key)."""
        out = np.full(len(hashes), -1, np.int64)
        left, base = np.arange(len(hashes)), 0
        for level, size in enumerate(self.levels):
            at = (mix(hashes[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = (base + at) >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            found = (self.bits[word] & bit) != 0
            below = np.bitwise_count(self.bits[word] & (bit - np.uint64(1)))
            out[left[found]] = (self.rank[word] + below)[found]
            left, base = left[~found], base + int(size)
        return out


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 977) >> np.uint64(32)).astype("<u4")


def build_shard(part: int, shard: int, start: int, docs: list, keys: list) -> tuple:
    """The row of one shard: payload, its keys, the hash, and a slot per key."""
    lengths = np.array([len(ids) for ids in docs], np.int64)
    nulls = np.array([k is None for k, _ in keys], bool)
    ids = np.array([k or 0 for k, _ in keys], "<i8")
    ordinals = np.array([n for _, n in keys], "<i8")
    seed = 0
    while len(np.unique(hashes := key_hash(ids, nulls, ordinals, seed))) < len(ids):
        seed += 2
    perfect = PerfectHash.build(hashes)
    slots = np.zeros(len(ids), SLOT)
    at = perfect.find(hashes)
    slots["print"][at] = _prints(hashes)
    slots["length"][at] = lengths
    slots["offset"][at] = np.cumsum(lengths) - lengths
    known = ids[~nulls]
    return (
        part, shard, start, int(lengths.sum()), len(ids), docs[0].dtype.itemsize,
        int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None,
        b"".join(d.tobytes() for d in docs), ids.tobytes(), np.packbits(nulls).tobytes(),
        ordinals.tobytes(), seed, perfect.levels.tobytes(), perfect.bits.tobytes(),
        slots.tobytes(),
    )


class Shard:
    """A shard as read from disk."""

    def __init__(self, row: dict):
        self.payload = np.frombuffer(row["payload"], f"<u{row['id_bytes']}")
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.ordinals = np.frombuffer(row["ordinals"], "<i8")
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8))[: len(self.keys)]
        self.seed = row["seed"]
        self.perfect = PerfectHash(
            np.frombuffer(row["levels"], "<u4"), np.frombuffer(row["bits"], "<u8")
        )
        self.slots = np.frombuffer(row["slots"], SLOT)

    def find(self, keys, nulls, ordinals) -> np.ndarray:
        """The slot of each key, -1 for keys that are not here by their fingerprint."""
        hashes = key_hash(keys, nulls, ordinals, self.seed)
        at = self.perfect.find(hashes)
        same = (at >= 0) & (self.slots["print"][at] == _prints(hashes))
        return np.where(same, at, -1)

    def ids(self, slot: int) -> np.ndarray:
        where = self.slots[slot]
        return self.payload[int(where["offset"]) : int(where["offset"]) + int(where["length"])]


def write_store(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = 0,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encodes documents and writes them as shards, in ascending order of ``doc_id``.

    A shard is one row of a Parquet table, so any store that Spark writes will
    do: raw little-endian ids (two bytes each if the vocabulary allows), the
    keys, the perfect hash, and per key a fingerprint, offset and length.  Null
    or empty texts have the end id alone.  Null keys come first; rows with equal
    keys are ordered by their texts and numbered from 0.  An empty table gives
    no shard.  Columns other than ``doc_id`` and ``text`` are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
        names = [p.split()[0] for p in SHARD_SCHEMA.split(",")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        types = [kinds[p.split()[1]] for p in SHARD_SCHEMA.split(",")]
        held, keys, size, shard, start, last = [], [], 0, 0, 0, object()
        number = 0

        def close() -> pa.RecordBatch:
            row = build_shard(part, shard, start, held, keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, types)], names=names
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                key, ids = doc_id.as_py(), to_ids(text.as_py(), end_id)
                number = number + 1 if key == last else 0
                last = key
                held.append(ids)
                keys.append((key, number))
                size += ids.nbytes
                if size >= shard_bytes:
                    yield close()
                    start += size // ids.itemsize
                    held, keys, size, shard = [], [], 0, shard + 1
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    encoded = text_batches(ordered).mapInArrow(encode, SHARD_SCHEMA)
    encoded.write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document, each found through its shard's hash."""
    shards = spark.read.parquet(path)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(_READ)}
                shard = Shard(row)
                slots = shard.find(shard.keys, shard.nulls, shard.ordinals)
                if (slots < 0).any():
                    raise ValueError(f"damaged shard in part {row['part']} of {path}")
                where = shard.slots[slots]
                crc = [zlib.crc32(shard.ids(s).astype("<u4")) for s in slots]
                keys = pa.array(shard.keys, pa.int64(), mask=shard.nulls.astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(slots), row["part"]), pa.int64()),
                        keys,
                        pa.array(where["offset"].astype(np.int64) + row["part_start"]),
                        pa.array(where["length"].astype(np.int64)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "doc_id", "part_offset", "n_tokens", "ids_crc32"],
                )

    # Parts are tasks of the writing job: a few thousand rows at any size.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = shards.select(*_READ).mapInArrow(
        look_up, "part long, doc_id long, part_offset long, n_tokens long, ids_crc32 long"
    )
    start = (F.col("base") + F.col("part_offset")).alias("start")
    return found.join(starts, "part").select("doc_id", start, "n_tokens", "ids_crc32")


def _ranges(keys: list[int], most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all sorted keys, cut at the widest gaps."""
    gaps = sorted(range(1, len(keys)), key=lambda i: keys[i - 1] - keys[i])[: most - 1]
    cuts = [0, *sorted(gaps), len(keys)]
    return [(keys[a], keys[b - 1]) for a, b in zip(cuts, cuts[1:])]


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids), one row for each document asked for; keys that are not stored give no row.

    Shards outside of a few ranges of keys are not read.  Of the others the
    ranges alone tell the first shard that can hold a key; only from those the
    payload is read, and there each key costs one look at the hash.  Of rows
    with equal keys the first is given.
    """
    schema = "doc_id long, ids array<long>"
    wanted = sorted({k for k in doc_ids if k is not None})
    if not wanted:
        return spark.createDataFrame([], schema)
    spans = [(F.col("first_key") <= high) & (F.col("last_key") >= low) for low, high in _ranges(wanted)]
    store = spark.read.parquet(path).filter(functools.reduce(operator.or_, spans))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array(wanted, "<i8")
        for batch in batches:
            part, shard, first, last = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            low = np.searchsorted(keys, first)
            n = np.searchsorted(keys, last, "right") - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            columns = [keys[at], np.repeat(part, n), np.repeat(shard, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "part", "shard"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({n: batch.column(k)[i].as_py() for k, n in enumerate(_READ)})
                keys = np.array(batch.column(len(_READ))[i].as_py(), "<i8")
                none = np.zeros(len(keys), np.int64)
                hits = [(int(k), shard.ids(s)) for k, s in zip(keys, shard.find(keys, none, none)) if s >= 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in hits], pa.int64()),
                        pa.array([ids.tolist() for _, ids in hits], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "ids"],
                )

    place = [F.col(c).cast("long").alias(c) for c in ("part", "shard")]
    held = store.select(*place, "first_key", "last_key").mapInArrow(holders, "key long, part long, shard long")
    first = held.groupBy("key").agg(F.min(F.struct("part", "shard")).alias("at"))
    # As many rows as keys were asked for, at most.
    asked = first.groupBy("at").agg(F.collect_list("key").alias("asked")).select("at.*", "asked")
    shards = store.join(F.broadcast(asked), ["part", "shard"]).select(*_READ, "asked")
    return shards.mapInArrow(look_up, schema)
