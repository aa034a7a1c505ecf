"""Packing, the keyed store and the word cache against the tokenizers library itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import sentence
from veilstat.llm import bpe, keyed_store, packing, wordpiece
from veilstat.llm.common import shared_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def _crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_equal_those_of_the_library(reference, odd_rows, monkeypatch):
    draw = random.Random(4)
    letters = "ab'sdtllveremZÉß  \t\n\r\x0b\x85\xa0\x1c_-09²½!?.,жξ中😀"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(800)]
    texts += ["<|endoftext|> in a text", "a <|endoftext|> b<|endoftext|>", "<|endoftext", "don't we'll I'm 'S 'x ''s", "  lead\n\n\n  in  "]
    texts += [t for _, t in odd_rows]
    encoder = bpe.Encoder(PATH)
    for text in texts:
        assert encoder.encode(text, 0).tolist() == reference(text)
    assert encoder.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    monkeypatch.setattr(bpe, "STRETCH", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.Encoder(PATH)
    for text in texts:
        assert small.encode(text, 0).tolist() == reference(text)


def test_differencing_deals_every_item_once():
    draw = random.Random(1)
    for windows in (1, 2, 3, 16):
        sizes = [draw.randint(1, 128) for _ in range(draw.randint(windows, 200))]
        sets = packing.differencing(sizes, windows)
        assert sorted(i for s in sets for i in s) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in s) for s in sets] + [0] * (windows - len(sets))
        assert max(sums) - min(sums) <= max(sizes)
    assert packing.differencing([], 3) == []
    # By hand: 8 against 7 and 6 against 5 leave 1 and 1; 4 against those, 3, then 2.
    values = [8, 7, 6, 5, 4]
    sums = [sum(values[i] for i in s) for s in packing.differencing(values, 2)]
    assert sorted(sums) == [14, 16]


def test_windows_rise_when_one_overflows():
    sets = packing.fit([60, 60, 60], 100)
    assert len(sets) == 3 and sorted(i for s in sets for i in s) == [0, 1, 2]


def _check_packing(rows, pieces, reference, capacity):
    texts = sorted((str(k), t or "") for k, t in rows)
    assert sum(p.length for p in pieces) == sum(len(reference(t)) for _, t in texts)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    keys = [k for k, _ in rows]
    for key, text in rows:
        if keys.count(key) > 1:
            continue
        ids, at = reference(text), 0
        for p in sorted(by_doc[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == _crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    for held in by_sequence.values():
        held.sort(key=lambda p: p.offset)
        assert [p.offset for p in held] == [sum(q.length for q in held[:i]) for i in range(len(held))]
        used = sum(p.length for p in held)
        assert used <= capacity and {p.sequence_tokens for p in held} == {used}
        assert held[0].padded_tokens == (used if used & (used - 1) == 0 else capacity)


def test_packing_of_odd_rows(frame, odd_rows, reference):
    docs = frame(odd_rows)
    _check_packing(odd_rows, packing.pack(docs).collect(), reference, 1024)
    small = packing.pack(docs, capacity=64, piece=16, windows=4, slack=2).collect()
    _check_packing(odd_rows, small, reference, 64)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_pads_little(frame):
    rows = [(i, sentence(i, 30 + 37 * i % 900)) for i in range(500)]
    pieces = packing.pack(frame(rows)).collect()
    padding = sum(p.padded_tokens - p.sequence_tokens for p in pieces if p.offset == 0)
    assert padding < 0.015 * sum(p.length for p in pieces)


@pytest.mark.parametrize("shard_bytes", [1, 300, 1 << 22])
def test_store_round_trip(spark, frame, odd_rows, reference, shard_bytes):
    path = shared_path(spark, "store")
    keyed_store.write_store(frame(odd_rows, 3), path, shard_bytes=shard_bytes)
    got = keyed_store.read_store(spark, path).orderBy("start").collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for row, (key, text) in zip(got, order, strict=True):
        ids = reference(text)
        assert (row.doc_id, row.start, row.n_tokens) == (key, at, len(ids))
        assert row.ids_crc32 == _crc(ids)
        at += len(ids)
    found = {r.doc_id: r.ids for r in keyed_store.fetch(spark, path, [5, -3, 999, 1 << 40]).collect()}
    assert found == {k: reference(t) for k, t in odd_rows if k in (5, -3, 1 << 40)}


def test_thousands_of_keys_and_equal_keys(spark, frame, reference):
    path = shared_path(spark, "store")
    rows = [(3 * i, f"text {i}") for i in range(4000)] + [(600, "text 200")] * 50
    keyed_store.write_store(frame(rows, 4), path, shard_bytes=400)
    asked = [*range(0, 12_000, 2), 600, 600, None, -5, 10**12]
    got = keyed_store.fetch(spark, path, asked).collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 12_000, 6))
    assert all(r.ids == reference(f"text {r.doc_id // 3}") for r in got[:50])
    assert keyed_store.fetch(spark, path, []).count() == 0


def test_store_of_an_empty_table(spark, frame):
    path = shared_path(spark, "store")
    keyed_store.write_store(frame([(1, "x")]).limit(0), path)
    assert keyed_store.read_store(spark, path).count() == 0


def test_perfect_hash_is_minimal():
    for n in (1, 2, 63, 5000):
        keys = np.arange(n, dtype=np.int64) * 1_000_003 - 17
        none = np.zeros(n, np.int64)
        hashes = keyed_store.key_hash(keys, none, none, 0)
        found = keyed_store.PerfectHash.build(hashes).find(hashes)
        assert sorted(found) == list(range(n))


def _greedy(word: bytes, initial: set, continuation: set) -> int:
    at = n = 0
    while at < len(word):
        pieces = initial if at == 0 else continuation
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_automaton_equals_greedy_matching():
    draw = random.Random(8)
    for _ in range(300):
        word = lambda: bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 6)))
        initial, continuation = {word() for _ in range(6)}, {word() for _ in range(8)}
        automaton = wordpiece.Automaton(sorted(initial), sorted(continuation))
        for _ in range(30):
            text = bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 14)))
            assert automaton.length(text) == _greedy(text, initial, continuation)


def test_token_counts_of_odd_rows(frame, odd_rows):
    initial, continuation = (set(p) for p in wordpiece.pieces_of(PATH))
    docs = frame(odd_rows)
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in wordpiece.token_counts(docs).collect())
    want = []
    for key, text in odd_rows:
        words = (text or "").encode().split()
        counts = {w: _greedy(b" " + w, initial, continuation) for w in set(words)}
        want.append((str(key), len(words), sum(counts[w] for w in words)))
    assert got == sorted(want)
    assert wordpiece.token_counts(docs.limit(0)).count() == 0
