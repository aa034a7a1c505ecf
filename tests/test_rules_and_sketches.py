"""Suffix rules, quantile rounds, sketches, headers in any order, ends of periods."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from veilstat.operators import classes as cl
from veilstat.operators import domains as dm
from veilstat.operators import lexical as lex
from veilstat.operators import quantiles as qt
from veilstat.plans import corpus as cp
from veilstat.sources.records import read_records_by_header

LIST = ["// a list", "", None, "uk", "co.uk", "*.ck", "!www.ck", "co.uk  twice", "*.deep.zz", "zz"]
DOMAINS = {
    "https://a.b.example.co.uk/x": "example.co.uk",
    "http://example.uk": "example.uk",
    "http://co.uk/": "co.uk",
    "http://shop.any.ck": "shop.any.ck",
    "http://x.shop.any.ck": "shop.any.ck",
    "http://any.ck": "any.ck",
    "http://a.www.ck": "www.ck",
    "http://www.ck": "www.ck",
    "http://A.B.Unlisted.": "b.unlisted",
    "http://127.0.0.1:80/": "127.0.0.1",
    "http://q.p.o.deep.zz": "p.o.deep.zz",
    "http://deep.zz": "deep.zz",
    "": None,
    None: None,
}


@pytest.mark.parametrize("room", [lex.BROADCAST_BYTES, 0])
def test_domains_by_rules(spark, monkeypatch, room):
    monkeypatch.setattr(lex, "BROADCAST_BYTES", room)
    rules = dm.suffix_rules(spark.createDataFrame([(x,) for x in LIST], "value string"))
    urls = spark.createDataFrame([(x,) for x in DOMAINS] * 2, "url string")
    got = dm.domains_by_rules(urls, "url", rules).collect()
    assert len(got) == 2 * len(DOMAINS)
    assert {r.url: r.domain for r in got} == DOMAINS
    assert dm.domains_by_rules(urls.limit(0), "url", rules).count() == 0
    bare = dm.domains_by_rules(urls, "url", rules.limit(0)).collect()
    assert {r.domain for r in bare if r.url == "https://a.b.example.co.uk/x"} == {"co.uk"}


@pytest.mark.parametrize(
    "values",
    [
        [random.Random(i).lognormvariate(0, 120) * (-1) ** i for i in range(4001)],
        [1.0 + i * 2.0**-52 for i in range(3000)] + [1e308, -1e308, 5e-324, 1e-323, 0.0],
        [5e-324 * i for i in range(50)] + [2.0**-1000, 1e300],
        [2.0**i for i in range(-1074, 1024)],
        [-1.0, -1.0 - 2**-52, -1e9, 1e9, 0.0, -0.0],
    ],
)
def test_rounds_of_quantiles_are_bounded(spark, monkeypatch, values):
    rounds = []
    histogram = qt._histogram
    monkeypatch.setattr(qt, "_histogram", lambda *a: rounds.append(1) or histogram(*a))
    order = sorted(values)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = qt.exact_quantiles(spark.createDataFrame([(x,) for x in values], "x double"), ["x"], probs)["x"]
    for p, g in zip(probs, got):
        at = (len(order) - 1) * p
        low, high = order[int(at)], order[min(int(at) + 1, len(order) - 1)]
        assert min(low, high) <= g <= max(low, high)
        if at == int(at):
            assert g == low
    assert len(rounds) <= qt.MOST_ROUNDS


def test_sketches_merge(spark):
    rows = [(i % 7, i % 5000 if i % 3 else None, "x") for i in range(60_000)]
    df = spark.createDataFrame(rows, "part int, a int, `b.c` string")
    stored = cl.cardinality_sketches(df, ["a", "b.c"], ["part"])
    assert stored.count() == 7
    got = {r.column: r.cardinality for r in cl.sketched_cardinality(stored, ["a", "b.c"]).collect()}
    assert got["b.c"] == 1 and got["a"] == pytest.approx(5001, rel=0.065)
    whole = cl.sketched_cardinality(cl.cardinality_sketches(df, ["a"]), ["a"]).first()
    assert whole.cardinality == pytest.approx(got["a"], rel=0.065)
    no_nulls = cl.cardinality_sketches(df.filter("a IS NULL"), ["a"], count_na=False)
    assert cl.sketched_cardinality(no_nulls, ["a"]).first().cardinality == 0
    empty = cl.cardinality_sketches(df.limit(0), ["a"], ["part"])
    assert cl.sketched_cardinality(empty, ["a"]).first().cardinality == 0


def test_columns_follow_each_header(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text('x,y\n1,"p,q"\n02,\n')
    (tmp_path / "2.csv").write_text("y,x\nr,3\n")
    (tmp_path / "3.csv").write_text("y,x\n")
    got = read_records_by_header(spark, str(tmp_path), ["x", "y"]).collect()
    assert sorted(map(tuple, got), key=str) == [("02", None), ("1", "p,q"), ("3", "r")]
    (tmp_path / "4.csv").write_text("y,z\n5,6\n")
    with pytest.raises(Exception, match="another header"):
        read_records_by_header(spark, str(tmp_path), ["x", "y"]).collect()


@pytest.mark.parametrize("room", [cp.BROADCAST_BYTES, 0])
def test_only_the_ends_of_a_period_are_measured(spark, monkeypatch, room):
    monkeypatch.setattr(cp, "BROADCAST_BYTES", room)
    days = ["20000103", "20000105", "20000105", "20000109", "20010101"]
    rows = [
        (f"{site}_{d}", f"We collect {i} cookies.", datetime.datetime.strptime(d, "%Y%m%d").date(), d, f"{site}{i}.txt")
        for site in ("a_b", "c") for i, d in enumerate(days)
    ]
    frame = spark.createDataFrame(rows, "name string, text string, date date, timestamp string, source_file string")
    words = spark.createDataFrame([("we", True, 1, 6.0)], "word string, easy boolean, syllables int, zipf double")
    got = cp.trend_of_texts(frame, words, "n_words").collect()
    assert sorted(r.source_file for r in got) == sorted(f"{s}{i}.txt" for s in ("a_b", "c") for i in (0, 3, 4))
    assert {r.year for r in got} == {2000, 2001} and [r.timestamp for r in got] == sorted(r.timestamp for r in got)
    assert cp.ends_of_periods(frame.filter(F.lit(False))).count() == 0
