"""Cosine search in large tiles; restarts of k-means in common rounds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from veilstat.operators import learn as ln
from veilstat.operators import textsim as ts
from veilstat.operators.spaces import Cosine

NOBODY = (np.array([], dtype=int), np.array([], dtype=int))


def _vectors(rng, rows, low):
    found = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)) for _ in range(rows)]
    return pd.DataFrame({"i": found, "w": [low + rng.integers(1, 4, len(i)) for i in found]})


@pytest.mark.parametrize("low", [0.0, -2.5])
@pytest.mark.parametrize("frequent", [0.0, 0.05, 1.0])
def test_least_cosines_are_those_of_all_pairs(monkeypatch, low, frequent):
    monkeypatch.setattr(Cosine, "frequent", frequent)
    monkeypatch.setattr(Cosine, "dense_columns", 7)
    monkeypatch.setattr(Cosine, "products", 50)
    rng, space, k = np.random.default_rng(1), Cosine(), 3
    asked, searched = _vectors(rng, 30, low), _vectors(rng, 200, low)
    dense = [np.zeros((len(x), 40)) for x in (asked, searched)]
    for rows, out in zip((asked, searched), dense):
        for r, (i, w) in enumerate(zip(rows["i"], rows["w"])):
            out[r, i] = w / np.sqrt((w * w).sum())
    far = np.round(1.0 - dense[0] @ dense[1].T, 9)
    far[((dense[0] != 0.0).astype(int) @ (dense[1] != 0.0).T.astype(int)) == 0] = np.inf
    far[5, 7] = np.inf

    a = space.take(space.block(pd.concat([asked, asked], ignore_index=True)), np.arange(30, 60))
    a, b = space.unpack(space.pack(a)), space.unpack(space.pack(space.block(searched)))
    row, column, rank, limit = space.least(a, b, (np.array([5]), np.array([7])), k, np.full(30, -np.inf))
    want = np.argsort(far, axis=1, kind="stable")[:, :k]
    kept = np.isfinite(np.take_along_axis(far, want, axis=1))
    assert column.tolist() == want[kept].tolist() and row.tolist() == np.nonzero(kept)[0].tolist()
    assert rank.tolist() == pytest.approx(far[row, column].tolist(), abs=2e-9)
    # Whoever reaches no further than others have before need not be ranked.
    assert not len(space.least(a, b, NOBODY, k, np.full(30, 1.1))[0])


def test_texts_are_dealt_once_for_their_vectors(spark):
    docs = spark.createDataFrame([(1, "apple pear pear"), (2, "apple plum"), (None, "plum fig"), (None, "fig")], "id int, text string")
    vectors = ts.tfidf_vectors(docs, "id")
    assert vectors._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = {r["id"]: r["w"] for r in vectors.collect()}
    assert {x: len(w) for x, w in rows.items()} == {1: 2, 2: 2, None: 2}
    assert max(rows[None]) == pytest.approx(2 * (np.log(5 / 2) + 1))


def test_runs_move_in_common_passes_and_end_where_spark_ends(spark, monkeypatch):
    monkeypatch.setattr(ln, "BLOCK_ROWS", 50)
    passes = []
    monkeypatch.setattr(ln, "_moments", lambda c, moments=ln._moments: passes.append(len(c)) or moments(c))
    x = np.random.default_rng(2).normal(size=(400, 2))
    points = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "k int, v array<double>").repartition(3)
    ready = points.withColumn("_x", array_to_vector("v")).localCheckpoint()
    runs = ln._settled(ready, "v", [ln._start(ready, 4, seed) for seed in range(3)], 1e-6)
    own = [KMeans(k=4, seed=seed, featuresCol="_x", tol=1e-6, maxIter=500).fit(ready) for seed in range(3)]
    for (centers, cost), model in zip(runs, own):
        assert centers == pytest.approx(np.array(model.clusterCenters()), abs=1e-5)
        assert cost == pytest.approx(model.summary.trainingCost, rel=1e-6)
    assert passes[0] == 3 and len(passes) == max(m.summary.numIter for m in own)


def test_clusters_of_fewer_points_than_clusters(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 1.0]), (3, [0.0, 0.0]), (4, [5.0, 1.0])], "k int, v array<double>")
    got = {r.k: r.cluster_label for r in ln.cluster(points, "v", key="k", restarts=2).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}
