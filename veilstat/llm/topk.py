"""Exact top-k search by inner product: tiles, partial selection, merged lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstat.llm.common import written

#: Bytes of the query vectors that one pass over the candidates takes along.
BLOCK_BYTES = 32 << 20
#: Candidates in one matrix product.
TILE = 2048
#: Lists that one step of the merging tree joins.
FAN = 32
_LEAST, _MOST = -(2**63 - 1), 2**63 - 1


def _usable(vector: Column) -> Column:
    """No null, no component that is null, infinite or not a number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then by smaller id; ids are one row per query."""
    order = np.lexsort((ids, -scores), axis=-1)
    order = order[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles: exact at any size."""
    most = np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * max(1, tile.shape[1])
    if most < 2**53:
        return (queries @ tile.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in queries], object).reshape(queries.shape)
    other = np.array([[int(x) for x in row] for row in tile], object).reshape(tile.shape)
    full = exact.dot(other.T)
    return np.array([[min(max(x, _LEAST), _MOST) for x in row] for row in full], np.int64)


def select(query_ids, queries, ids, tile, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best rows of a tile, without rows of its own id.

    Rows of the query's own id are marked by a score below any other.
    """
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], _products(queries, tile[order])
    scores[query_ids[:, None] == ids[None, :]] = _LEAST - 1
    n = len(ids)
    most = int(np.abs(scores[scores >= _LEAST]).max(initial=0))
    if n > k and most < 2**62 // n:
        # Score and place in one number without ties: a partial selection is exact.
        keys = np.where(scores < _LEAST, -(2**62), scores * n) - np.arange(n)
        at = np.argpartition(-keys, k - 1, axis=1)[:, :k]
        scores = np.take_along_axis(scores, at, 1)
        return _best(scores, ids[at], k)
    return _best(scores, np.broadcast_to(ids, scores.shape), k)


def search(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products.

    Components become floor(scale * x).  Ties go to the smaller key; fewer than
    ``k`` candidates give fewer rows.  Rows without a key and vectors that are
    null or hold a null or non-finite component take no part, nor do candidates
    of the query's own key, nor vectors of another length.  Rows with equal keys
    are candidates each; of queries with equal keys the least vector counts.
    Scores beyond 64 bits are held at the ends of the range.

    Queries are dealt to blocks of ``block_bytes`` at most; a block is the only
    thing that is broadcast, and each makes one pass over the candidates.  A task
    keeps one list per query, and lists are merged in a tree by Spark.
    """

    def whole(df: DataFrame) -> DataFrame:
        exact = F.transform(vector, lambda x: x.cast("double"))
        rows = df.filter(F.col(key).isNotNull() & _usable(F.col(vector)))
        return rows.select(F.col(key).cast("long").alias("id"), exact.alias("v"))

    asked = whole(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(asked, "queries")
    size = asked.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    blocks = max(1, -(-2 * int(size) // block_bytes))
    rows, spark = whole(candidates), candidates.sparkSession
    schema = "part long, query_id long, best array<struct<n:long, vec_id:long>>"
    kind = pa.list_(pa.struct([("n", pa.int64()), ("vec_id", pa.int64())]))
    names = ["part", "query_id", "best"]

    def one_block(number: int) -> DataFrame:
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).collect()
        by_length: dict[int, list] = {}
        for row in block:
            by_length.setdefault(len(row.v), []).append(row)
        held = {
            n: (
                np.array([r.id for r in rows_n], np.int64),
                np.floor(np.array([r.v for r in rows_n]).reshape(len(rows_n), n) * scale),
            )
            for n, rows_n in by_length.items()
        }
        sent = spark.sparkContext.broadcast(held)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_here, best = sent.value, {}
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                vectors = batch.column(1)
                sizes = np.diff(vectors.offsets.to_numpy())
                flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale)
                starts = np.cumsum(sizes) - sizes
                for n, (query_ids, matrix) in asked_here.items():
                    where = np.flatnonzero(sizes == n)
                    for i in range(0, len(where), TILE):
                        at = where[i : i + TILE]
                        tile = flat[starts[at][:, None] + np.arange(n)[None, :]]
                        found = select(query_ids, matrix, ids[at], tile, k)
                        if n in best:
                            old = best[n]
                            found = _best(*(np.hstack(p) for p in zip(old, found)), k)
                        best[n] = found
            part = TaskContext.get().partitionId()
            for n, (scores, near) in best.items():
                query_ids = asked_here[n][0]
                lists = [
                    [{"n": -s, "vec_id": v} for s, v in zip(a, b) if s >= _LEAST]
                    for a, b in zip(scores.tolist(), near.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(query_ids), part), pa.int64()),
                        pa.array(query_ids),
                        pa.array(lists, kind),
                    ],
                    names=names,
                )

        return rows.mapInArrow(scan, schema)

    lists = one_block(0)
    for number in range(1, blocks):
        lists = lists.union(one_block(number))
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    parts = blocks * rows.rdd.getNumPartitions()  # tasks of a union are numbered through
    while parts > 1:
        parts = -(-parts // FAN)
        upper = F.floor(F.col("part") / FAN).alias("part")
        lists = lists.groupBy("query_id", upper).agg(merged)
    flat = lists.select("query_id", F.posexplode("best").alias("pos", "b"))
    return flat.select(
        "query_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.n")).alias("score"),
    )
