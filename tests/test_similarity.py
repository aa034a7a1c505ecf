"""Medians, z-scores, projection, clusters and neighbours."""

import io
import math
import random
import re
import statistics
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilstat import lexicons as lx
from veilstat.operators import classes as cl
from veilstat.operators import features as ft
from veilstat.operators import learn as ln
from veilstat.operators import neighbors as nb
from veilstat.operators import textsim as ts
from veilstat.operators.quantiles import exact_quantiles
from veilstat.plans.similarity import similarity_reports

# Published features of seven documents.
METRICS = """name,n_words,n_sents,flesch_kincaid_grade,gunning_fog,smog_index,dale_chall,coleman_liau,ari,avg_sentence_length,ttr,yule_k,entropy,avg_zipf,rare_frac,legalese_frac
amazon,4164,160,16.22708909702209,19.747175792507207,17.48930111497398,11.730236253602305,14.539193083573487,17.644276034236803,26.025,0.2192919933475885,93.47650818503675,8.219078940060168,5.60751722499406,0.009265858873841768,0.0042765502494654314
apple,4637,200,14.950187524261377,17.874388182014236,16.162427332266308,11.225744923873194,13.362993314643091,15.207038494257766,23.185,0.20290771175726927,99.28382034934735,8.113057145437917,5.679806152549515,0.00969237252423093,0.009481668773704172
google,10254,401,14.368148280556653,17.472431268230828,15.655499669430327,11.58331455703437,12.816227813536184,15.852249331928526,25.571072319201996,0.13981293992864718,97.85711086765096,8.273859039593315,5.675013017066821,0.012534953234982162,0.004821135859608524
meta,5546,149,19.25403541339426,21.5961275676042,17.712588265843667,11.76907542602807,13.470429138117563,21.978787470440118,37.22147651006711,0.12970191625266148,130.59234435830496,7.616435519724579,5.770186302342086,0.007452093683463449,0.0049680624556423
palantir,8974,300,18.095678493425456,21.26776257336008,18.61334746637692,12.33250465403759,14.800891464229998,19.869173333333336,29.913333333333334,0.14153439153439154,102.23546723216036,8.185523048785104,5.646391093474427,0.02358906525573192,0.01179453262786596
tiktok,4621,187,15.078498484597752,17.761574861102595,15.991686286952746,11.087967959686482,13.740532352304701,16.579070808207227,24.711229946524064,0.1917691981332202,114.01868687841433,7.959119946710777,5.740239711497666,0.01230377598642342,0.0067882901994060245
x,5605,252,13.235983709273182,16.16176741288249,14.917219407550412,10.996546670348188,11.77916146297948,13.770104804584726,22.24206349206349,0.18319928507596067,105.25164096310299,8.085788982454954,5.742539767649688,0.018409294012511172,0.006613047363717605
"""
# Published neighbours: name, in the same cluster, overall.
NEIGHBORS = {
    "meta": (None, None, "tiktok", 5.5123),
    "apple": ("tiktok", 1.5984, "tiktok", 1.5984),
    "tiktok": ("apple", 1.5984, "apple", 1.5984),
    "x": ("apple", 1.9064, "apple", 1.9064),
    "palantir": (None, None, "amazon", 4.0622),
    "amazon": ("google", 2.0920, "apple", 2.0433),
    "google": ("amazon", 2.0920, "apple", 1.8430),
}


def test_published_reports(spark):
    metrics = spark.createDataFrame(pd.read_csv(io.StringIO(METRICS)))
    neighbors, prototypes = similarity_reports(metrics)
    rows = {r["name"]: r for r in neighbors.collect()}
    got = {n: (r["nearest_same_type"], r["dist_same_type"], r["nearest_overall"], r["dist_overall"]) for n, r in rows.items()}
    assert got == NEIGHBORS
    clusters = {}
    for n, r in rows.items():
        clusters.setdefault(r["cluster_label"], set()).add(n)
    assert sorted(map(sorted, clusters.values())) == [["amazon", "google"], ["apple", "tiktok", "x"], ["meta"], ["palantir"]]
    by_cluster = {frozenset(clusters[r["cluster_label"]]): r for r in prototypes.collect()}
    alone = by_cluster[frozenset({"meta"})]
    assert (alone["prototype"], alone["prototype_nearest_same"], alone["distance"]) == ("meta", None, None)
    pair = by_cluster[frozenset({"amazon", "google"})]
    assert {pair["prototype"], pair["prototype_nearest_same"]} == {"amazon", "google"} and pair["distance"] == 2.092


def test_absent_features():
    class Columns:
        columns = ["n_words", "ari", "other"]

    assert ft.select_features(Columns, ["n_words", "ttr", "ari"]) == (["n_words", "ari"], ["ttr"])


@pytest.mark.parametrize(
    "values",
    [
        [3.0], [1.0, 2.0], [5.0] * 9, [None, 1.0, None],
        [math.exp(random.Random(i).gauss(0, 30)) * (-1) ** i for i in range(3001)],
        [float(i % 3) for i in range(1000)],
        [float("inf"), float("inf"), 1.0, 2.0, float("nan")],
        [1e300, -1e300, 0.0, 1e-300, 5.0, 1.7e308, -1.7e308],
    ],
)
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    present = np.array([v for v in values if v is not None and v == v])
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["v"], probs)["v"]
    order = np.sort(present)
    for p, g in zip(probs, got):
        at = (len(order) - 1) * p
        low, high = order[math.floor(at)], order[math.ceil(at)]
        want = low if low == high else low + (high - low) * (at - math.floor(at))
        assert g == pytest.approx(want, rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}


def test_median_and_zscore(spark):
    data = [(1, 1.0, 7.0), (2, None, 7.0), (3, float("inf"), 7.0), (4, 4.0, 7.0), (5, 9.0, 7.0), (6, float("nan"), 7.0)]
    df = spark.createDataFrame(data, "id int, a double, flat double")
    filled = ft.median_impute(df, ["a", "flat"]).orderBy("id")
    assert [r["a"] for r in filled.collect()] == [1.0, 4.0, 4.0, 4.0, 9.0, 4.0]
    got = ft.zscore(filled, ["a", "flat"]).orderBy("id").collect()
    a = [1.0, 4.0, 4.0, 4.0, 9.0, 4.0]
    mean, std = statistics.mean(a), statistics.pstdev(a)
    assert [r["a"] for r in got] == pytest.approx([(x - mean) / std for x in a])
    assert {r["flat"] for r in got} == {0.0}


def test_describe(spark):
    df = spark.createDataFrame([(str(i),) for i in range(1, 11)] + [("",)], "v string").select(F.col("v").try_cast("double").alias("v"))
    row = ft.describe(df, "v").first().asDict()
    want = pd.Series(range(1, 11), dtype=float).describe()
    assert list(row.values()) == pytest.approx(list(want))


def brute(points, group):
    out = {}
    for key, v, g in points:
        others = [
            (math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), k) for k, w, h in points if k != key and (not group or h == g)
        ]
        d, k = min(others, default=(None, None))
        out[key] = (k, None if d is None else round(d, 9))
    return out


@pytest.mark.parametrize("share", [4096, 2])
@pytest.mark.parametrize(("group", "dim", "sent"), [(None, 2, 0), ("g", 2, 1 << 26), (None, 6, 1 << 26), ("g", 6, 0)])
def test_nearest_matches_brute_force(spark, monkeypatch, group, dim, sent, share):
    # Small packs make many cells; a third of the points are copies of one.
    monkeypatch.setattr(nb, "PACK_ROWS", 16)
    monkeypatch.setattr(nb, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(cl, "HOT_SHARE", share)
    rng = random.Random(dim)
    points = []
    for i in range(400):
        v = [0.5] * dim if i % 3 == 0 else [round(rng.gauss(i % 5, 0.4), 2) for _ in range(dim)]
        points.append((f"k{i:03d}", v, i % 4))
    points.append(("solo", [9.0] * dim, 99))
    df = spark.createDataFrame(points, "key string, v array<double>, g int")
    got = {r["key"]: (r["neighbor"], None if r["distance"] is None else round(r["distance"], 9)) for r in nb.nearest(df, "key", "v", group).collect()}
    assert got == brute(points, group)


@pytest.mark.parametrize("rows", [4, None])
def test_top2_texts_match_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(nb, "PACK_ROWS", rows)
    rng = random.Random(5)
    common = [f"common{c}" for c in "abcdefghijklmnop"]
    texts = {i: " ".join(rng.choices(common, k=rng.randrange(1, 30)) + [f"rare{'xyzuvw'[i % 6]}"]) for i in range(60)}
    texts |= {100: texts[0], 101: texts[1], 102: texts[1], 103: texts[1], 200: "", 201: "lonely", 202: "the and"}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    labels = docs.select("id", F.lit(1).alias("cluster_label"))
    got = {r["id"]: r for r in ts.top2_neighbors(docs, "id", labels=labels).collect()}

    tf = {i: Counter(re.findall("[a-z]+", t)) for i, t in texts.items()}
    tf = {i: {w: n for w, n in c.items() if w not in lx.STOPWORDS and len(w) > 2} for i, c in tf.items()}
    df = Counter(w for c in tf.values() for w in c)
    vec = {i: {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()} for i, c in tf.items()}
    norm = {i: math.sqrt(sum(x * x for x in c.values())) for i, c in vec.items()}
    for i in texts:
        sims = []
        for j in texts:
            if i != j and (dot := sum(x * vec[j].get(w, 0.0) for w, x in vec[i].items())) > 0:
                sims.append((round(1 - dot / norm[i] / norm[j], 9), j))
        want = [(j, pytest.approx(1 - d, abs=6e-5)) for d, j in sorted(sims)[:2]]
        want += [(None, None)] * (2 - len(want))
        r = got[i]
        assert [(r["neighbor_1"], r["sim_1"]), (r["neighbor_2"], r["sim_2"])] == want
        assert r["cluster_label"] == 1


def test_nearest_edges(spark):
    schema = "key int, v array<double>"
    assert nb.nearest(spark.createDataFrame([], schema), "key", "v").count() == 0
    assert tuple(nb.nearest(spark.createDataFrame([(1, [1.0])], schema), "key", "v").first()) == (1, None, None)


def test_silhouette(spark):
    rng = random.Random(3)
    points = [(i, [rng.random(), rng.random() + i % 3], i % 3) for i in range(60)] + [(60, [9.0, 9.0], 7)]
    df = spark.createDataFrame(points, "id int, v array<double>, label int")
    x, y = np.array([p[1] for p in points]), np.array([p[2] for p in points])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    scores = []
    for i in range(len(x)):
        mine = (y == y[i]) & (np.arange(len(x)) != i)
        if not mine.any():
            scores.append(0.0)
            continue
        own, other = d[i][mine].mean(), min(d[i][y == c].mean() for c in set(y) - {y[i]})
        scores.append((other - own) / max(own, other))
    assert ln.silhouette(df, "v", "label") == pytest.approx(np.mean(scores))
    assert ln.silhouette(df.filter("label = 0"), "v", "label") is None


def test_projection_matches_svd(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(80)))
    got = ln.project(ft.zscore(df, names), "id", names).orderBy("id").collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    for i, axis in enumerate(vt[:2]):
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        assert [r["point"][i] for r in got] == pytest.approx(list(z @ axis))


def test_feature_names():
    assert len(lx.FEATURES) == 15
