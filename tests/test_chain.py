"""Canonical clusters, text files of any bytes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilstat.operators.learn import cluster
from veilstat.sources.corpus import clean_text_files, read_texts, write_texts


@pytest.mark.parametrize("restarts", [1, 5])
def test_clusters_are_numbered_by_their_least_key(spark, restarts):
    rows = [(10 * g + i, [100.0 * ((g * 7) % 4) + 0.1 * i, 0.0]) for g in range(4) for i in range(5)]
    points = spark.createDataFrame(rows, "k int, v array<double>")
    got = {r.k: r.cluster_label for r in cluster(points, "v", restarts=max(restarts, 5), key="k").collect()}
    assert got == {k: k // 10 for k, _ in rows}
    plain = cluster(points, "v", restarts=restarts)
    assert plain.columns == ["k", "v", "cluster_label"]


TEXTS = {
    "plain": "One line\nand another\n",
    "a/b c+%=d": "name with signs",
    "empty": "",
    "none": None,
    "wide": "中文 😀 é",
    "spaces": "  kept  ",
}


def test_text_files_come_back_as_written(spark, tmp_path):
    folder = str(tmp_path / "texts")
    rows = spark.createDataFrame(list(TEXTS.items()), "name string, text string").repartition(3)
    write_texts(rows.withColumn("value", F.lit("another column")), folder)
    got = {r["name"]: r["text"] for r in read_texts(spark, folder).collect()}
    assert got == {k: v or "" for k, v in TEXTS.items()}
    write_texts(rows.filter("name = 'plain'"), folder)
    assert read_texts(spark, folder).count() == 1


def test_bytes_of_another_encoding_are_dropped(spark, tmp_path):
    folder, out = str(tmp_path / "texts"), str(tmp_path / "cleaned")
    bad = spark.createDataFrame([("x", "señor cincón the end é"), ("y", "\u00f3")], "name string, text string")
    write_texts(bad.withColumn("text", F.encode("text", "ISO-8859-1").cast("string")), folder)
    got = {r["name"]: r["text"] for r in read_texts(spark, folder).collect()}
    assert got == {"x": "seor cincn the end ", "y": ""}
    cleaned = clean_text_files(spark, folder, out)
    assert {r["name"]: r["text"] for r in cleaned.collect()} == {"x": "seor cincn end", "y": ""}


def test_texts_share_files_and_keep_every_byte(spark, tmp_path):
    folder = str(tmp_path / "texts")
    texts = {f"n{i}": f"text {i}" for i in range(200)}
    texts |= {"a\\n\tb\n": "\\n is no line feed\\", "cr": "one\r\ntwo\rthree\ttab\\t\n", "\\N": "no null name"}
    rows = spark.createDataFrame([*texts.items(), ("", "x"), (None, None), ("n7", "text 7")], "name string, text string")
    write_texts(rows.repartition(3), folder)
    assert len(list((tmp_path / "texts").glob("**/*.txt"))) <= 20
    got = [(r["name"], r["text"]) for r in read_texts(spark, folder).collect()]
    none = [text for name, text in got if name is None]
    assert len(got) == len(texts) + 1 and sorted(none[0].split("\n")) == ["", "x"]
    assert {k: v for k, v in got if k is not None} == texts | {"n7": "text 7\ntext 7"}
    write_texts(rows.filter("name LIKE 'n1_'"), folder, apart=True)
    assert {r["name"]: r["text"] for r in read_texts(spark, folder, apart=True).collect()} == {f"n{i}": f"text {i}" for i in range(10, 20)}
