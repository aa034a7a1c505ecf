"""k-anonymity operators: edge cases, properties, pandas semantics."""

import random

import pytest
from pyspark.sql import functions as F

from veilstat.functions import generalize as gz
from veilstat.operators import classes as cl
from veilstat.operators import suppress as sp
from veilstat.plans import deid
from veilstat.sources.records import read_records, write_csv
from veilstat.spec import QISpec, counter_columns, find_role


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    # One class holds a third of the rows, the others are small or alone.
    data = [(i, "c", None, "x", "1") for i in range(200)]
    data += [(i, "c", rng.choice(["a", "b", None]), rng.choice("xyz"), str(rng.randrange(40))) for i in range(200, 600)]
    return spark.createDataFrame(data, "user_id int, course_id string, p string, q string, `r.s` string").persist()


QIS = ["p", "q", "r.s"]


def classes_by_hand(df):
    sizes = {}
    for r in df.collect():
        sizes.setdefault(tuple(r[2:]), []).append(r["user_id"])
    return sizes


def test_spec(rows):
    assert QISpec.of(rows) == QISpec(("user_id", "course_id"), ("p", "q", "r.s"))


@pytest.mark.parametrize("share", [4096, 20])
def test_class_sizes_match_by_hand(rows, monkeypatch, share):
    # With a small share both branches of the join have rows.
    monkeypatch.setattr(cl, "HOT_SHARE", share)
    by_hand = classes_by_hand(rows)
    want = {i: len(ids) for ids in by_hand.values() for i in ids}
    assert {r["user_id"]: r["class_size"] for r in cl.record_class_size(rows, QIS).collect()} == want
    kept = {r["user_id"] for r in sp.record_suppression(rows, QIS, 3).collect()}
    assert kept == {i for i, n in want.items() if n >= 3}
    alone = {(r["user_id"], r["count"]) for r in cl.violating_records(rows, QIS).collect()}
    assert alone == {(i, 1) for i, n in want.items() if n == 1}


def test_suppression_properties(rows):
    kept = sp.record_suppression(rows, QIS, 4).persist()
    summary = sp.suppression_summary(rows, QIS, 4).first()
    assert summary.rows_kept == kept.count()
    assert summary.rows_kept + summary.deleted_rows == summary.rows_source == 600
    assert summary.k_after == cl.k_value(kept, QIS) >= 4
    assert sp.record_suppression(kept, QIS, 4).count() == kept.count()


def test_k_edges(spark, rows):
    assert cl.k_value(rows, []) == 600
    assert cl.k_value(rows.limit(0), QIS) == 0
    assert cl.k_value(rows.limit(0), []) == 0
    assert cl.k_value(rows, "q") == min(r["count"] for r in rows.groupBy("q").count().collect())
    assert cl.class_count(rows, []).first()["n_classes"] == 1
    assert sp.record_suppression(rows, [], 5).count() == 600
    assert sp.suppression_summary(rows.limit(0), QIS).first().asDict() == {
        "rows_source": 0, "deleted_rows": 0, "rows_kept": 0, "k_after": 0,
    }
    nulls = rows.select("user_id", F.lit(None).cast("string").alias("p"))
    assert cl.k_value(nulls, ["p"]) == 600


def test_cardinality_counts_null_once(rows):
    with_na = {r["column"]: r["cardinality"] for r in cl.qi_cardinality(rows, QIS).collect()}
    without = {r["column"]: r["cardinality"] for r in cl.qi_cardinality(rows, QIS, count_na=False).collect()}
    assert with_na["p"] == 3 and without["p"] == 2
    assert with_na["q"] == without["q"] == 3


def greedy_by_hand(data, qis, target):
    """The rule, written over tuples."""
    def k_and_groups(cols):
        if not cols:
            return len(data), 1
        sizes = {}
        for row in data:
            key = tuple(row[c] for c in cols)
            sizes[key] = sizes.get(key, 0) + 1
        return min(sizes.values(), default=0), len(sizes)

    card = {c: len({row[c] for row in data}) for c in qis}
    left, dropped, k = list(qis), [], k_and_groups(qis)[0]
    while k < target and left:
        top = max(card[c] for c in left)
        def rank(c):
            kk, groups = k_and_groups([x for x in left if x != c])
            return (-kk, groups, c)
        best = min((c for c in left if card[c] == top), key=rank)
        left.remove(best)
        dropped.append(best)
        k = k_and_groups(left)[0]
    return dropped, k, left


@pytest.mark.parametrize("seed", range(4))
def test_greedy_matches_by_hand(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d"]
    width = [rng.choice([2, 3, 3, 9]) for _ in names]
    data = [{c: rng.choice([None, *map(str, range(w))]) for c, w in zip(names, width)} for _ in range(120)]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(data)], "user_id int, a string, b string, c string, d string")
    got = sp.greedy_column_suppression(df, QISpec.of(df), 5)
    assert (got.dropped, got.k, got.remaining) == greedy_by_hand(data, names, 5)
    levels = [s.k for s in got.steps]
    assert levels == sorted(levels)


def test_greedy_may_drop_all(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(4)], "user_id int, a string")
    got = sp.greedy_column_suppression(df, QISpec.of(df), 3)
    assert (got.dropped, got.k, got.remaining) == (["a"], 4, [])
    assert sp.column_suppression(df, QISpec.of(df), 9) is None
    assert sp.column_suppression(df, QISpec.of(df), 3).columns == ["user_id"]
    empty = sp.greedy_column_suppression(df.limit(0), QISpec.of(df), 3)
    assert (empty.dropped, empty.k) == (["a"], 0)


def one(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_birth(spark):
    values = ["1999", " 2000 ", "2000-02-30", "2001-05-17", "5/17/2001", "5/17/1995", "x", "", None, "1e4", "nan", "inf", "2001d"]
    want = ["pre-2000", "2000+", "pre-2000", "2000+", "2000+", "pre-2000", "pre-2000", "pre-2000", "pre-2000", "2000+", "pre-2000", "2000+", "pre-2000"]
    assert one(spark, gz.birth_bucket, values) == want


def test_country_and_city(spark):
    values = ["us", " in ", "AU", "BR", "", None, "nan", "Unknown", "NA", "zz"]
    want = ["North", "North", "North", "South", "North", "North", "North", "North", "North", "South"]
    assert one(spark, gz.hemisphere, values) == want
    assert one(spark, lambda c: gz.hemisphere_city(gz.hemisphere(c)), ["US", "BR"]) == ["Tokyo", "São Paulo"]


def test_postal(spark):
    values = ["02139", "SW1A", "AB", "9", None, "", " none ", "NA", " 7"]
    assert one(spark, gz.postal_binary, values) == [0, 0, 1, 1, 1, 1, 1, 1, 1]
    assert one(spark, gz.postal_prefix, values) == ["00000", "10000", "00000", "90000", "00000", "00000", "00000", "00000", "70000"]


def test_education(spark):
    values = ["Post-Secondary", "Bachelor's", "less than HS", "PhD", "MD", "Associate", "graduate", "", None, "unknown", "other"]
    low, high = "≤Secondary", "Tertiary+"
    assert one(spark, gz.education_binary, values) == [low, high, low, high, high, high, high, low, low, low, low]


def test_counters(spark):
    values = ["0", "1", "5", "5.5", "21", "-3", None, "x", " 20 ", "inf"]
    assert one(spark, gz.counter_binary, values) == [0, 1, 1, 1, 1, 0, 0, 0, 1, 1]
    assert one(spark, gz.counter_bins, values) == ["0", "1-5", "1-5", "6-20", "21+", "0", "0", "0", "6-20", "21+"]


def test_gender(spark):
    assert one(spark, gz.gender_normalized, ["O", " Male", "m", "F", "female", None, "", "None", "X "]) == ["m", "m", "m", "f", "f", "f", "f", "f", "x"]


def test_roles():
    assert find_role(["Country", "REGION", "CC_by_IP"], ("cc_by_ip", "country")) == "CC_by_IP"
    assert find_role(["country by IP"], ("country_by_ip",)) is None
    assert find_role(["country by IP"], ("country_by_ip",), loose=True) == "country by IP"
    assert counter_columns(["Number of posts pinned", "user_posts", "city", "nplay_x"]) == ["Number of posts pinned", "user_posts", "nplay_x"]


def test_generalize_by_role(spark):
    df = spark.createDataFrame(
        [("u", "Rio", "BR", "1980", 3, True)], "user_id string, City string, Region string, DOB string, `Number of views` int, has_votes boolean"
    )
    got = gz.generalize(df)
    assert got.columns == df.columns
    assert tuple(got.first()) == ("u", "São Paulo", "South", "pre-2000", 1, 1)
    no_country = gz.generalize(df.drop("Region")).first()
    assert no_country["City"] == "UnknownCity"


def test_generalizing_never_adds_classes(spark, rows):
    df = rows.withColumnRenamed("p", "country").withColumnRenamed("r.s", "nforum_posts")
    qis = QISpec.of(df).qis
    assert cl.class_count(gz.generalize(df), qis).first()[0] <= cl.class_count(df, qis).first()[0]


def test_combination_picks_second_stage(spark, rows):
    first, second = rows, rows.drop("r.s")
    kept, summary = deid.combination(rows, k=5, stages=[first, second])
    assert cl.k_value(first, QIS) < 5
    assert kept.columns == second.columns
    assert summary.first().rows_kept == kept.count()


def test_csv_round_trip(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text('user_id,postalCode,cc\n1,02139,NA\n2,,"a ""q"", b"\n3,n/a,US\n')
    df = read_records(spark, str(source))
    want = [("1", "02139", None), ("2", None, 'a "q", b'), ("3", None, "US")]
    assert [tuple(r) for r in df.orderBy("user_id").collect()] == want
    write_csv(df, str(tmp_path / "out"))
    again = read_records(spark, str(tmp_path / "out"), df.columns)
    assert [tuple(r) for r in again.orderBy("user_id").collect()] == want
