"""SimHash groups, benchmark passages and top-k search against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import sentence
from veilstat.llm import decontam, simhash, topk


def _fingerprint(text: str | None, k: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(marks: dict) -> dict:
    """Least key reachable over marks at two bits or fewer."""
    label = {m: m for m in marks.values()}
    distinct = list(label)

    def root(m):
        while label[m] != m:
            m = label[m]
        return m

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    least: dict = {}
    for key, mark in marks.items():
        least[root(mark)] = min(least.get(root(mark), key), key)
    return {key: least[root(mark)] for key, mark in marks.items()}


def _near_rows():
    rows = [(i, sentence(i, 5 + 11 * i % 300)) for i in range(60)]
    for i in range(60, 110):  # copies with one word changed
        words = sentence(i % 5 + 300, 400).split()
        words[3 * i % 400] = f"w{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, sentence(7, 82)) for i in range(20)]
    return rows + [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE")]


@pytest.mark.parametrize("crowded", [64, 1])
def test_groups_equal_brute_force(frame, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "STRETCH", 100)
    rows = _near_rows()
    marks = {k: _fingerprint(t) for k, t in rows}
    want = _groups(marks)
    got = simhash.near_duplicates(frame(rows)).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == marks
    assert {r.doc_id: r.component_id for r in got} == want
    assert any(k != v for k, v in want.items() if 60 <= k < 110)


@pytest.mark.parametrize("crowded", [64, 1])
@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links_of_random_marks(spark, monkeypatch, crowded, max_bits):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    draw = random.Random(max_bits)
    marks = {draw.getrandbits(64) for _ in range(20)}
    for _ in range(150):
        marks.add(draw.choice(sorted(marks)) ^ (1 << draw.randrange(64)))
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    links = simhash.links(spark.createDataFrame(signed, "bits long"), max_bits)
    parts = simhash.components(links).collect()
    root = {r.node: r.root for r in parts}
    label = {m: {m} for (m,) in signed}
    for (a,) in signed:
        for (b,) in signed:
            if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits and label[a] is not label[b]:
                label[a] |= label[b]
                for c in label[b]:
                    label[c] = label[a]
    assert all(root.get(m, m) == min(label[m]) for (m,) in signed)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _plans_written(monkeypatch) -> dict[str, str]:
    """From now on, the plans of the tables that simhash writes, by name."""
    plans, write = {}, simhash.written

    def note(df, name):
        plans[name] = _plan(df)
        return write(df, name)

    monkeypatch.setattr(simhash, "written", note)
    return plans


def test_exploded_fingerprints_are_not_broadcast(spark, monkeypatch):
    plans = _plans_written(monkeypatch)
    draw = random.Random(5)
    marks = [(draw.getrandbits(63),) for _ in range(50)]
    links = simhash.links(spark.createDataFrame([*marks, (marks[0][0] ^ 1,)], "bits long"))
    assert "Broadcast" not in plans["cells"] + _plan(links)
    assert [tuple(r) for r in links.collect()] == [tuple(sorted((marks[0][0], marks[0][0] ^ 1)))]


def test_many_documents_are_kept_without_estimates(frame, monkeypatch):
    rows = _near_rows() + [(None, "no id here"), (None, "no id here"), (9, "another text")]
    want = simhash.keep_one(frame(rows)).collect()
    monkeypatch.setattr(simhash, "ESTIMATED_ROWS", 0)
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    plans = _plans_written(monkeypatch)
    kept = simhash.keep_one(frame(rows))
    assert "Broadcast" not in "".join(plans.values()) + _plan(kept)
    assert sorted(map(str, kept.collect())) == sorted(map(str, want))


def test_many_documents_are_grouped_without_estimates(frame, monkeypatch):
    want = simhash.near_duplicates(frame(_near_rows())).collect()
    monkeypatch.setattr(simhash, "ESTIMATED_ROWS", 0)
    found = simhash.near_duplicates(frame(_near_rows()))
    assert "Broadcast" not in _plan(found)
    assert sorted(found.collect()) == sorted(want)


@pytest.mark.parametrize("ids", [simhash.BROADCAST_IDS, 0])
def test_one_of_each_group_stays(spark, frame, monkeypatch, ids):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", ids)
    rows = _near_rows() + [(7, sentence(7, 82)), (None, "no id here"), (None, "no id here"),
                           (None, sentence(7, 82)), (9, "another text under a used id")]
    kept = simhash.keep_one(frame(rows)).collect()
    by_mark = {}
    for k, t in rows:
        by_mark.setdefault(_fingerprint(t), []).append(k)
    groups = {}
    marks = {m: m for m in by_mark}
    for m, g in _groups(marks).items():
        groups.setdefault(g, []).append(m)
    assert len(kept) == len(groups)
    kept_marks = {_fingerprint(r.text) for r in kept}
    assert all(len(kept_marks & set(g)) == 1 for g in groups.values())
    assert simhash.keep_one(frame(rows).limit(0)).count() == 0


def test_columns_that_clash_stay(frame):
    rows = _near_rows()[:70] + [(7, "again"), (7, "again"), (None, "no id")]
    names = ["_gone", "_again", "_row", "_id", "_bits", "bits", "key", "row", "id", "c0", "root"]
    docs = frame(rows).withColumns({n: F.lit(f"own {n}") for n in names})
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert {r.text for r in kept} == {r.text for r in simhash.keep_one(frame(rows)).collect()}
    assert all(r[n] == f"own {n}" for r in kept for n in names)


def test_long_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and got[1001] == 1000


def _least_edits(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_alignment_equals_brute_force():
    draw, letters = random.Random(3), "abcdefgh "
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    for _ in range(150):
        item = word(draw.randint(8, 120))
        text = list(item)
        for _ in range(draw.randint(0, 14)):
            at, kind = draw.randrange(len(text) + 1), draw.random()
            text[at : at + (kind < 0.7)] = [] if 0.4 < kind < 0.7 else [draw.choice(letters)]
        text = word(draw.choice([0, 3, 40])) + "".join(text) + word(draw.choice([0, 2, 30]))
        items = decontam.Items([(1, item)])
        if not len(items.codes):
            continue
        plain = ["".join(map(chr, c)) for c in (items.codes[0], decontam.normal(text))]
        edits = _least_edits(*plain)
        import pyarrow as pa

        found = decontam._search_batch(items, pa.array([word(30), text, None, word(30)]))[1]
        assert found.get(0) == (edits if edits <= items.edits[0] else None)


def test_benchmark_passages(spark, frame, odd_rows, monkeypatch):
    monkeypatch.setattr(decontam, "PORTION", 500)
    monkeypatch.setattr(decontam, "ENTRIES", 300)
    items = [(i, sentence(500 + i, 40)) for i in range(6)] + [(6, None), (7, "short"), (None, sentence(900, 30))]
    edited = items[1][1].replace("the", "a", 1).replace("river", "rivers", 1)
    rows = odd_rows + [
        (100, sentence(1, 200) + " " + items[0][1].upper() + "!! " + sentence(2, 100)),
        (101, edited),
        (102, " ".join(sentence(3, 40).split()[:20] + items[2][1].split()[:20])),
        (103, sentence(4, 300)),
        (104, items[3][1].replace(" ", "\n--\n") + items[4][1]),
        (None, items[5][1]),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_CHARS, 150):
        got = decontam.find(frame(rows), benchmark, block_chars=block).collect()
        assert sorted((str(r.doc_id), r.item_id) for r in got) == [
            ("100", 0), ("101", 1), ("104", 3), ("104", 4), ("None", 5)
        ]
        clean = decontam.decontaminate(frame(rows), benchmark, block_chars=block)
        assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = sorted(str(r.doc_id) for r in clean.collect())
        assert left == sorted([str(k) for k, _ in odd_rows] + ["102", "103"])
    assert decontam.find(frame(rows), benchmark.limit(0)).count() == 0
    assert decontam.find(frame(rows).limit(0), benchmark).count() == 0
    assert decontam.decontaminate(frame(rows), benchmark.limit(0)).count() == len(rows)


def test_parts_of_long_items_and_short_items(spark, frame):
    long = sentence(700, 120)
    words = long.split()
    items = [(1, long), (2, "42 km"), (None, "Zürich!"), (4, "???"), (5, "x9"), (5, "x9 "), (6, sentence(701, 50))]
    rows = [
        (10, sentence(1, 80) + " " + " ".join(words[13:87]) + " " + sentence(2, 90)),
        (11, " ".join(words[30:75])),
        (12, long + " and " + long.replace("the", "a", 1)),
        (13, "It is 42  KM."), (14, "a42 km, 42 kmh, 42 k m"), (15, "in zürich"), (16, "x9"), (17, ""), (18, None),
        (19, " ".join(sentence(701, 50).split()[:40])),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(str, map(tuple, decontam.find(frame(rows), benchmark).collect())))
    assert got == sorted(map(str, [
        (10, 1, 0, False), (12, 1, 0, True), (13, 2, 0, True), (15, None, 0, True), (16, 5, 0, True), (16, 5, 0, True)
    ]))
    left = sorted(r.doc_id for r in decontam.decontaminate(frame(rows), benchmark).collect())
    assert left == [11, 14, 17, 18, 19]


def test_portions_of_places_count_alike(monkeypatch):
    items = decontam.Items([(i, sentence(40 + i // 4, 60) + f" {i}") for i in range(40)])
    codes = decontam.normal(sentence(1, 30) + " " + sentence(43, 60) + " 13 " + sentence(45, 60))
    want = [x.tolist() for x in items.regions(codes)]
    assert len(want[0])
    for entries in (1, 7, 1000):
        monkeypatch.setattr(decontam, "ENTRIES", entries)
        assert [x.tolist() for x in items.regions(codes)] == want


@pytest.mark.parametrize("block_bytes", [topk.BLOCK_BYTES, 500])
def test_top_k_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(topk, "TILE", 7)
    monkeypatch.setattr(topk, "FAN", 2)
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 4) / 2]) for i in range(90)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4)]
    rows += [(None, [9.0] * 4), (204, [1.0, 2.0]), (205, [2.0, 2.0]), (206, []), (207, []), (30, [1.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    usable = [(k, np.floor(256 * np.array(v))) for k, v in rows if k is not None and v is not None
              and not any(x is None or not np.isfinite(x) for x in v)]
    queries = vectors.filter("vec_id % 10 = 0 or vec_id in (204, 206)")
    got = {}
    for r in topk.search(vectors, queries, 5, block_bytes=block_bytes).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = {}
    for k, v in usable:
        if k % 10 == 0 or k in (204, 206):
            asked[k] = min(asked.get(k, v), v, key=list)
    want = {}
    for k, q in asked.items():
        near = sorted((-int(q @ v), j) for j, v in usable if j != k and len(v) == len(q))[:5]
        if near:
            want[k] = [(i + 1, j, -s) for i, (s, j) in enumerate(near)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert topk.search(vectors.limit(0), queries).count() == 0
    assert topk.search(vectors, queries.limit(0)).count() == 0


def test_top_k_of_huge_components_is_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 1.5]), (3, [3e38, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(vectors, vectors.filter("vec_id = 0"), 3).orderBy("rank").collect()
    big = int(256 * 3e6) ** 2
    assert [(r.vec_id, r.score) for r in got] == [
        (3, 2**63 - 1), (1, big + 256 * 512), (2, big + 256 * 384)
    ]


def test_cells_hold_counts_of_bits(spark):
    mark = -0x123456789ABCDEF
    got = spark.range(1).select(simhash.segment_counts(F.lit(mark))).first()[0]
    bits = mark & (1 << 64) - 1
    assert got == sum(((bits >> 4 * i) & 15).bit_count() << 4 * i for i in range(16))
