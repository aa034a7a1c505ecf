"""Cases that went wrong once: history, headers, null groups, hot words, references."""

from __future__ import annotations

import datetime
import html

import pytest
from pyspark.sql import functions as F

from veilstat.functions.pages import decode_entities
from veilstat.operators import classes as cl
from veilstat.operators import lexical as lex
from veilstat.operators import neighbors as nb
from veilstat.plans import corpus as cp
from veilstat.sources.corpus import upsert_corpora
from veilstat.sources.records import read_records

WORD_LIST = "word string, easy boolean, syllables int, zipf double"


def test_two_files_of_one_date(spark):
    day = datetime.date(1999, 6, 9)
    rows = [(f"site_19990609", "We collect cookies here. ", day, "19990609", f) for f in ("06_09_1999.txt", "6_9_1999.txt")]
    frame = spark.createDataFrame(rows, "name string, text string, date date, timestamp string, source_file string")
    words = spark.createDataFrame([("we", True, 1, 6.0)], WORD_LIST)
    got = cp.history_metrics(frame, words).collect()
    assert [r.source_file for r in got] == ["06_09_1999.txt", "6_9_1999.txt"]
    single = cp.history_metrics(frame.limit(1), words).first()
    assert all(r[c] == single[c] for r in got for c in cp.METRICS)
    assert got[0].year == 1999


def test_endless_and_missing_values_count_as_the_median(spark):
    rows = [("20000101", 1.0), ("20000201", float("inf")), ("20000301", None), ("20000401", 3.0), ("20000501", 5.0)]
    got = cp.history_zscore(spark.createDataFrame(rows, "timestamp string, x double"), ["x"]).collect()
    filled = [1.0, 3.0, 3.0, 3.0, 5.0]
    deviation = (sum((x - 3) ** 2 for x in filled) / 5) ** 0.5
    assert [r.x for r in got] == pytest.approx([(x - 3) / deviation for x in filled])


def test_headers_in_another_order_are_not_swapped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    assert [tuple(r) for r in read_records(spark, str(tmp_path)).collect()] == [("1", "2")]
    (tmp_path / "b.csv").write_text("b,a\n5,6\n")
    with pytest.raises(Exception, match="(?i)header|read"):
        read_records(spark, str(tmp_path), ["a", "b"]).collect()


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x\ny",2\n3,4\n')
    got = read_records(spark, str(tmp_path / "a.csv"), multi_line=True).collect()
    assert sorted(map(tuple, got)) == [("3", "4"), ("x\ny", "2")]


def test_null_is_a_group(spark):
    rows = [(1, [0.0], None), (2, [1.0], None), (3, [0.1], "a"), (4, [9.0], "a"), (5, [0.0], "")]
    got = nb.nearest(spark.createDataFrame(rows, "k int, v array<double>, g string"), "k", "v", "g")
    assert {r.k: r.neighbor for r in got.collect()} == {1: 2, 2: 1, 3: 4, 4: 3, 5: None}


def test_prototype_report_by_hand(spark):
    rows = [(1, [0.0], 0), (2, [1.0], 0), (3, [2.5], 0), (4, [7.0], 1), (5, [3.0], None), (6, [3.0], None)]
    got = nb.prototype_report(spark.createDataFrame(rows, "k int, v array<double>, g int"), "k", "v", "g")
    found = {r.cluster_label: (r.prototype, r.prototype_nearest_same, r.distance) for r in got.collect()}
    assert found == {0: (2, 1, 1.0), 1: (4, None, None), None: (5, 6, 0.0)}


def test_half_of_all_tokens_is_one_word(spark, monkeypatch):
    texts = [(i, "the " * 50 + " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(25)) * 2) for i in range(20)]
    docs = spark.createDataFrame([*texts, (99, None)], "k int, text string")
    words = spark.createDataFrame([("the", 7.0), ("waa", 2.0), ("wbb", 4.0)], "word string, zipf double")
    short = {r.k: r for r in lex.zipf_stats(docs, "k", words).collect()}
    monkeypatch.setattr(lex, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lex, "HOT_SHARE", 10)
    long = {r.k: r for r in lex.zipf_stats(docs, "k", words).collect()}
    assert long.keys() == short.keys()
    for k, row in long.items():
        assert tuple(row) == pytest.approx(tuple(short[k]))


def test_upsert_of_names_that_occur_again(spark, monkeypatch):
    schema = "name string, text string"
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("y", "3"), (None, "n")], schema)
    b = spark.createDataFrame([("y", "2"), ("y", "1"), ("z", "2"), (None, "m")], schema)
    want = {"x": "1", "y": "2", "z": "2", None: "m"}
    for size in (1 << 20, 0):
        monkeypatch.setattr("veilstat.sources.corpus.BROADCAST_BYTES", size)
        assert {r["name"]: r["text"] for r in upsert_corpora(a, b).collect()} == want


def test_lonely_rows_keep_all_columns(spark):
    rows = [(1, "a", None, 5), (2, "a", None, 6), (3, None, "b", 7)]
    frame = spark.createDataFrame(rows, "id int, q1 string, q2 string, other int")
    got = cl.violating_records(frame, ["q1", "q2"]).collect()
    assert [tuple(r) for r in got] == [(3, None, "b", 7, 1)]


def test_references_are_read_as_browsers_do(spark):
    texts = [
        "&sect; 5 &eacute;t&eacute; &trade; &euro;5", "&copy 1 &notit; &am &amp; &amp;lt; &ampx &AMP",
        "&#8217;&#x2019 &#150; &#0; &#xD800; &#99999999999;", "a & b &; &x &NotEqualTilde;", "plain", "&", "",
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select(decode_entities(F.col("t"))).collect()
    assert [r[0] for r in got] == [html.unescape(t) for t in texts]
