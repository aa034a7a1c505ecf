"""Long word lists read the texts once; history keeps no copy of them; slices of packs."""

import pytest
from pyspark.sql import functions as F

from veilstat.operators import lexical as lex
from veilstat.operators import neighbors as nb
from veilstat.operators.spaces import Dense
from veilstat.plans import corpus as cp

TEXTS = ["The cat sat on the mat. It was a very happy cat, indeed.", "Città di Roma è bella e the end is near now.", "", "a a a b", None]


def _words(spark, texts):
    lexicon = lex.zipf_lexicon(texts, "doc_id").localCheckpoint()
    return lexicon.select("word", "zipf", F.when(F.col("zipf") > 8.4, True).alias("easy"), F.length("word").alias("syllables"))


@pytest.mark.parametrize("measure", [cp.readability, cp.corpus_metrics])
@pytest.mark.parametrize("room", [2, 150])
def test_a_long_list_reads_the_texts_once(spark, monkeypatch, tmp_path, measure, room):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    words = _words(spark, docs)

    def rows(df):
        # Sums are added in another order.
        return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())

    short = rows(measure(docs, "doc_id", words))
    monkeypatch.setattr(lex, "BROADCAST_BYTES", room)
    found = measure(docs, "doc_id", words)
    assert rows(found) == short
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_history_keeps_no_copy_of_the_texts(spark, monkeypatch):
    rows = [(f"s_2020010{i}", t, f"2020010{i}", f"f{i}.txt") for i, t in enumerate(TEXTS[:2], 1)]
    frame = spark.createDataFrame(rows, "name string, text string, timestamp string, source_file string")
    frame = frame.withColumn("date", F.to_date("timestamp", "yyyyMMdd"))
    words = _words(spark, frame.withColumnRenamed("name", "doc_id"))
    monkeypatch.setattr(cp, "cut_lineage", lambda df: pytest.fail("written"))
    assert [r["source_file"] for r in cp.history_metrics(frame, words).collect()] == ["f1.txt", "f2.txt"]


def test_packs_are_sent_in_slices():
    room = nb.BROADCAST_BYTES
    slices = nb._slices({0: room // 2, 1: room // 2, 2: 1, 3: 3 * room})
    assert slices == [([0, 1], 1, 0), ([3], 3, 0), ([3], 3, 1), ([3], 3, 2), ([2], 1, 0)]


def test_least_ranks_are_those_of_all_pairs():
    import numpy as np

    a = np.random.default_rng(0).integers(0, 3, (40, 5)).astype(float)
    none = (np.array([], dtype=int), np.array([], dtype=int))
    space = Dense(5)
    row, column, rank = space.least(a, a, none, 3)
    want = np.argsort(space.rank(a, a), axis=1, kind="stable")[:, :3]
    assert (column.reshape(-1, 3) == want).all() and (row == np.repeat(np.arange(40), 3)).all()
