"""Projection and clustering with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat import lexicons as lx
from veilstat.operators.features import median_impute, select_features, zscore
from veilstat.operators.neighbors import squared
from veilstat.session import cut_lineage

N_CLUSTERS = 4
# Points that a task compares with the centres of all runs at a time.
BLOCK_ROWS = 1 << 13


def feature_points(
    metrics: DataFrame, key: str, wanted: Sequence[str] = lx.FEATURES, dims: int = 2
) -> DataFrame:
    """(key, point): the features present, filled, standardized and projected."""
    features, _ = select_features(metrics, wanted)
    # The medians read the table several times; texts must not be read again for them.
    table = cut_lineage(metrics.select(key, *features))
    scaled = zscore(median_impute(table, features), features)
    return project(scaled, key, features, dims)


def project(scaled: DataFrame, key: str, features: Sequence[str], dims: int = 2) -> DataFrame:
    """Principal components of centred columns, as an array column ``point``.

    The sign of a component is free; here its largest loading is positive. The
    driver holds one matrix of features by features.
    """
    wide = VectorAssembler(inputCols=list(features), outputCol="_x").transform(scaled)
    wide = cut_lineage(wide.select(key, "_x"))
    model = PCA(k=dims, inputCol="_x", outputCol="_p").fit(wide)
    loadings = model.pc.toArray()
    largest = abs(loadings).argmax(axis=0)
    signs = [1.0 if loadings[largest[i], i] >= 0 else -1.0 for i in range(dims)]
    turned = vector_to_array("_p")
    point = F.array(*[turned[i] * F.lit(signs[i]) for i in range(dims)])
    return model.transform(wide).select(key, point.alias("point"))


def cluster(
    points: DataFrame,
    vector: str,
    k: int = N_CLUSTERS,
    restarts: int = 20,
    label: str = "cluster_label",
    tol: float = 1e-6,
    key: str | None = None,
) -> DataFrame:
    """Points with the labels of the k-means run of lowest cost.

    With a ``key`` the clusters are numbered from 0 by their members of least
    key, so that equal partitions have equal labels whatever run they are from.

    A run starts from Spark's k-means|| centres of its seed and ends when no centre
    moves further than ``tol``, so only settled runs are compared. Each pass over the
    points moves the centres of all runs that have not ended.
    """
    ready = cut_lineage(points.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>"))))
    runs = _settled(ready, vector, [_start(ready, k, seed) for seed in range(restarts)], tol)
    centers, _ = min(runs, key=lambda run: run[1])
    away = F.array(*[squared(F.col(vector).cast("array<double>"), F.array(*map(F.lit, c))) for c in centers.tolist()])
    number = (F.array_position(away, F.array_min(away)) - 1).cast("int")
    labelled = ready.drop("_x").withColumn(label, number)
    if key is None:
        return labelled
    first = labelled.groupBy(label).agg(F.min(key).alias("first")).orderBy("first").collect()
    numbers = F.create_map(*[F.lit(x) for i, row in enumerate(first) for x in (row[0], i)])
    return labelled.withColumn(label, numbers[F.col(label)]) if first else labelled


def _start(ready: DataFrame, k: int, seed: int) -> np.ndarray:
    """The centres that a run of ``KMeans`` starts from; fewer where there are fewer points."""
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="_c", maxIter=0).fit(ready)
    return np.array(model.clusterCenters())


def _settled(ready: DataFrame, vector: str, starts: list[np.ndarray], tol: float) -> list[tuple[np.ndarray, float]]:
    """(centres, cost) of each run, all runs moved by the same passes over the points."""
    k, dim = max(map(len, starts)), starts[0].shape[1]
    centers = np.full((len(starts), k, dim), np.inf)
    for run, start in enumerate(starts):
        centers[run, : len(start)] = start
    costs, moving = np.zeros(len(starts)), np.arange(len(starts))
    blocks = cut_lineage(ready.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(_as_blocks, "data binary"))
    while len(moving):
        now = centers[moving]
        parts = blocks.mapInPandas(_moments(now), "data binary").collect()
        total = sum(np.frombuffer(r["data"]).reshape(len(moving), k, dim + 2) for r in parts)
        n = total[:, :, 1]
        # A centre that no point is nearest to stays.
        held = n > 0
        moved = now.copy()
        moved[held] = total[:, :, 2:][held] / n[held][:, None]
        costs[moving] = total[:, :, 0].sum(axis=1)
        centers[moving] = moved
        far = np.zeros(held.shape)
        far[held] = np.sqrt(((moved[held] - now[held]) ** 2).sum(axis=1))
        moving = moving[(far > tol).any(axis=1)]
    return [(run[np.isfinite(run).all(axis=1)], cost) for run, cost in zip(centers, costs)]


def _as_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            yield pd.DataFrame({"data": [np.stack(pdf["v"].to_list()).astype(np.float64).tobytes()]})


def _moments(centers: np.ndarray):
    """Per task: of each run's centre the cost, number and sum of the points nearest to it."""
    runs, k, dim = centers.shape
    flat = centers.reshape(runs * k, dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 2, runs * k))
        for pdf in batches:
            for data in pdf["data"]:
                points = np.frombuffer(data).reshape(-1, dim)
                for low in range(0, len(points), BLOCK_ROWS):
                    x = points[low : low + BLOCK_ROWS]
                    away = sum((x[:, i, None] - flat[None, :, i]) ** 2 for i in range(dim)).reshape(len(x), runs, k)
                    nearest = away.argmin(axis=2)
                    least = np.take_along_axis(away, nearest[:, :, None], axis=2)
                    at = (nearest + np.arange(runs) * k).ravel()
                    total[0] += np.bincount(at, least.ravel(), runs * k)
                    total[1] += np.bincount(at, minlength=runs * k)
                    for i in range(dim):
                        total[i + 2] += np.bincount(at, np.repeat(x[:, i], runs), runs * k)
        yield pd.DataFrame({"data": [np.ascontiguousarray(total.T).tobytes()]})

    return run


def silhouette(points: DataFrame, vector: str, label: str) -> float | None:
    """Mean silhouette over squared Euclidean distances; null below two clusters.

    Over squares the sums to a cluster follow from its size, mean and sum of
    squares, so the cost grows with the points and not with their pairs.
    """
    if len(points.select(label).distinct().limit(2).collect()) < 2:
        return None
    ready = points.select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("_x"), F.col(label).cast("double").alias("_y")
    )
    return ClusteringEvaluator(featuresCol="_x", predictionCol="_y").evaluate(ready)
