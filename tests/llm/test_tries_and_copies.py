"""Prefix trie, exact duplicates and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilstat.llm import exact_dedup, prefix_trie, spelling

CONVERSATIONS = "conv_id long, turn long, role string, text string"
EMPTY_SHA = hashlib.sha256().hexdigest()


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# Exact duplicates


def _copies(rows):
    shas = [hashlib.sha256(_lower(t).encode()).hexdigest() for _, t in rows]
    groups = defaultdict(list)
    for (key, _), sha in zip(rows, shas):
        groups[sha].append(key)
    least = lambda keys: max((k for k in keys if k is not None), default=None)
    return sorted(((k, least(groups[s]), len(groups[s]), s) for (k, _), s in zip(rows, shas)), key=repr)


@pytest.mark.parametrize("bits", [exact_dedup.MOST_BITS, 1024, 1])
def test_copies_equal_brute_force(frame, odd_rows, bits, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SEGMENT_BITS", 1 << 11)
    monkeypatch.setattr(exact_dedup, "CHUNK", 300)
    rows = odd_rows + [(1000 + i, f"Text {i % 700}") for i in range(1500)] + [(9000 + i, "HOT") for i in range(800)]
    rows += [(9900, "hot"), (9901, "É"), (9902, "é")]
    found = exact_dedup.exact_duplicates(frame(rows, 4), most_bits=bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == _copies(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_only_possible_copies_are_taken(spark, frame):
    rows = frame([(i, f"text {i}") for i in range(5000)] + [(i, "again") for i in range(5000, 5100)], 4)
    digests = exact_dedup.digests(rows)
    maybe = exact_dedup.possibly_repeated(spark, digests, 5100).filter("maybe").count()
    assert 100 <= maybe < 250


def test_copies_of_nothing_and_clashing_columns(spark, frame):
    assert exact_dedup.exact_duplicates(frame([(1, "a")]).limit(0)).count() == 0
    names = ["row", "sha", "maybe", "best", "group_size", "kept", "_key0"]
    rows = frame([(1, "a"), (2, "A"), (3, "b")])
    more = rows.withColumns({n: F.lit("x") for n in names})
    assert sorted(exact_dedup.exact_duplicates(more).collect()) == sorted(exact_dedup.exact_duplicates(rows).collect())


# Spelling variants


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _variants(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for word, n in words.items():
        near = [w for w in words if _near(w, word)]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        form = best if best and words[best] >= 5 * n else None
        out[word] = [n, len(near), form, words.get(form)]
    for word in out:
        root = word
        while out[root][2]:
            root = out[root][2]
        out[word].append(root)
    return {w: tuple(v) for w, v in out.items()}


def _variant_rows():
    draw = random.Random(3)
    bases = ["garden", "gardens", "aabbaabb", "écrivain", "letters", "zzzzzz", "zzzzzzz"]
    rows = []
    for i in range(900):
        word = draw.choice(bases)
        kind = draw.randrange(8)
        at = draw.randrange(len(word))
        if kind == 0:
            word = word[:at] + draw.choice("aegzÿÉ") + word[at + 1 :]
        elif kind == 1:
            word = word[:at] + word[at + 1 :]
        elif kind == 2:
            word = word[:at] + draw.choice("aez") + word[at:]
        rows.append((i // 2, f"{word.upper() if i % 5 == 0 else word}, {word}-2{draw.choice(bases)} short"))
    # A chain of forms: each five times as common as the one before, and more.
    for word, n in (("chained", 7), ("chainee", 40), ("chainoe", 220), ("chainox", 1300)):
        rows += [(10_000 + i, word) for i in range(n)]
    return rows


def test_variants_equal_brute_force(frame, odd_rows, monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 40)
    monkeypatch.setattr(spelling, "HELD", 20)
    rows = _variant_rows() + odd_rows * 3 + [(20_000 + i, "y" * 700 + "É") for i in range(6)]
    found = spelling.variants(frame(rows, 3)).collect()
    expected = _variants(rows)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == expected
    assert len(found) == len(expected)
    assert expected["chained"][2] == "chainee" and expected["chained"][4] == "chainox"


def test_variants_of_nothing_and_clashing_columns(frame):
    assert spelling.variants(frame([(1, "a")]).limit(0)).count() == 0
    assert spelling.variants(frame([(1, None), (2, ""), (3, "short words only")])).count() == 0
    rows = frame(_variant_rows()[:200])
    more = rows.withColumns({n: F.lit("x") for n in ("word", "n", "key", "edited", "near", "best")})
    assert sorted(spelling.variants(more).collect()) == sorted(spelling.variants(rows).collect())


# Prefix trie


def _trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    seqs = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for key, convs in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(convs) - 1) * len(key[-1][1].encode()) if key else 0
    out = []
    for key, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(key), parent, len(convs), children[key], leaves[key], saved[key], sha))
    return sorted(out, key=repr)


def _conversation_rows():
    draw = random.Random(11)
    rows = []
    for c in range(160):
        length = 40 if c == 50 else draw.randrange(1, 12)
        for t in range(length):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", draw.choice(["yes", "no", "", "Grüße", None])))
    for c in range(200, 260):  # one start for all, many equal ends
        rows += [(c, t, "user", f"hot {t}") for t in range(6)] + [(c, 6, "user", str(c % 3))]
    rows += [(300, None, "user", "first"), (300, -1, None, "second"), (300, 0, "user", None)]
    rows += [(c, 0, "a", "x" * 70_000) for c in (305, 306, 307)]
    rows += [(400, 0, "ab", "c"), (401, 0, "a", "bc"), (402, 0, "a", "bc")]
    return rows


@pytest.mark.parametrize("batches", [prefix_trie.BATCHES, (8,)])
def test_trie_equals_brute_force(spark, batches, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = _conversation_rows()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows + [(None, 0, "user", "of no conversation")], CONVERSATIONS)
    found = prefix_trie.trie(df.repartition(3), batches).collect()
    assert sorted((tuple(r) for r in found), key=repr) == _trie(rows)


def test_trie_of_repeated_rows_and_long_chains(spark):
    # Each conversation is the beginning of the next; equal turns are turns of their own.
    rows = [(5 * c, 0, "u", "same") for c in range(33) for _ in range(c)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    assert sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=repr) == _trie(rows)


def test_trie_of_nothing_turnless_and_clashing_columns(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.trie(df).count() == 0
    # 1 takes its first turns from 0, which is missing, and has no more of its own.
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(lone, 0, "u", "x")]
    found = prefix_trie.trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert [tuple(r) for r in found] == _trie(rows)
    assert found[0].depth == 0 and found[0].n_leaves == 1 and found[0].ends_sha256 != EMPTY_SHA
    rows = _conversation_rows()[:60]
    plain = spark.createDataFrame(rows, CONVERSATIONS)
    more = plain.withColumns({n: F.lit("x") for n in ("rank", "d", "hash", "part", "node", "digest", "low", "_c")})
    assert sorted(prefix_trie.trie(more).collect()) == sorted(prefix_trie.trie(plain).collect())


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    df = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.two_fattest("a", "b").alias("f"))
    for a, b, f in df.collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)
