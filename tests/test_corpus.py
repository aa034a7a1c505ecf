"""Text functions, pages, sources and snapshots."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilstat.functions import pages as pg
from veilstat.functions import readability as rd
from veilstat.functions import text as tx
from veilstat.operators import lexical as lex
from veilstat.plans import corpus as cp
from veilstat.sources import corpus as sc
from veilstat.sources import snapshots as sn

TEXTS = {
    "plain": "We collect cookies, and we retain them. You may opt-out!  Our processor is liable?",
    "quotes": "Apple’s users don't sell. It’s e.g. fine — naïve café.",
    "odd": "﻿A​b c d\x1fe\n\nf g. h i.",
    "empty": "",
    "dots": "... !!! ???",
    "numbers": "Section 12.5 holds 3_000 words_and x",
    "shout": "NO MERCY HERE. NO! We The People Are.",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "name string, text string").persist()


def by_name(df):
    return {r["name"]: r.asDict() for r in df.collect()}


def test_clean_text(docs):
    got = by_name(docs.select("name", tx.clean_text(F.col("text")).alias("t")))
    for name, raw in TEXTS.items():
        assert got[name]["t"] == re.sub(r"\s+", " ", raw.replace("​", "").replace("﻿", "")).strip()


def test_counts_by_hand(docs):
    exprs = tx.basic_counts(F.col("text")) | tx.index_counts(F.col("text"))
    got = by_name(docs.select("name", *[e.alias(n) for n, e in exprs.items()]))

    def words(s):
        return re.sub(r"[^\w\s]", "", s).split()

    for name, t in TEXTS.items():
        g = got[name]
        assert g["n_chars"] == len(t)
        assert g["n_words"] == len(words(t)), name
        assert g["n_sents"] == max(1, sum(len(words(s)) > 2 for s in re.split(r"[.!?]+", t))), name
        assert g["n_nonspace"] == len(re.sub(r"\s", "", t)), name
        assert g["n_letters"] == len(re.sub(r"[\W]", "", t)), name
        assert g["n_runs"] == len(t.split()), name


def test_lexical_stats_by_hand(docs):
    got = by_name(cp.lexical_stats(docs, "name"))
    for name, t in TEXTS.items():
        tokens = [x.lower() for x in re.findall(r"[A-Za-z']+", t)]
        if not tokens:
            assert got[name] == {"name": name, "ttr": 0.0, "yule_k": 0.0, "entropy": 0.0, "legalese_frac": 0.0}
            continue
        freq, n = Counter(tokens), len(tokens)
        assert got[name]["ttr"] == pytest.approx(len(freq) / n)
        assert got[name]["yule_k"] == pytest.approx(1e4 * (sum(v * v for v in freq.values()) - n) / n**2)
        assert got[name]["entropy"] == pytest.approx(-sum(v / n * math.log2(v / n) for v in freq.values()), abs=1e-9)
    assert got["plain"]["legalese_frac"] == pytest.approx(3 / 15)


LEXICON = [("we", 6.0), ("cookies", 4.0), ("liable", 2.5), ("processor", 1.5), ("retain", 1.51)]


@pytest.mark.parametrize("limit", [lex.BROADCAST_BYTES, 2])
def test_lookups_short_and_long_list(spark, docs, monkeypatch, limit):
    # A limit of two words takes the way of long lists.
    monkeypatch.setattr(lex, "BROADCAST_BYTES", limit)
    words = spark.createDataFrame(LEXICON, "word string, zipf double")
    got = by_name(lex.zipf_stats(docs, "name", words))
    for name, t in TEXTS.items():
        z = [dict(LEXICON).get(x.lower(), 0.0) for x in re.findall(r"[A-Za-z']+", t)]
        assert got[name]["avg_zipf"] == pytest.approx(sum(z) / len(z) if z else 0.0)
        assert got[name]["rare_frac"] == pytest.approx(sum(x < 3 for x in z) / len(z) if z else 0.0)
    clean = by_name(lex.clean_corpus(docs, "name", lexicon=words))
    assert clean["plain"]["cleaned"] == "cookies retain liable"
    assert clean["empty"] == {"name": "empty", "cleaned": "", "clean_words": 0}
    every = by_name(lex.clean_corpus(docs, "name"))
    assert every["plain"]["cleaned"] == "collect cookies retain may opt processor liable"


def test_zipf_lexicon(docs):
    got = {r["word"]: (r["n"], r["zipf"]) for r in lex.zipf_lexicon(docs, "name").collect()}
    freq = Counter(x.lower() for t in TEXTS.values() for x in re.findall(r"[A-Za-z']+", t))
    total = sum(freq.values())
    assert got == {w: (n, pytest.approx(round(math.log10(n / total * 1e9), 2))) for w, n in freq.items()}


def test_word_list_overrides_syllables(spark, docs):
    easy = spark.createDataFrame([("we",), ("them",)], "word string")
    counts = spark.createDataFrame([("cookies", 2), ("collect", 7)], "word string, syllables int")
    words = lex.word_list(easy, counts)
    got = by_name(lex.word_counts(docs, "name", words))["plain"]
    text_words = re.sub(r"[^\w\s]", "", TEXTS["plain"]).lower().split()
    known = {"cookies": 2, "collect": 7}

    def syllables(w):
        return known.get(w) or max(1, len(re.findall("[aeiouy]+", w)) - bool(re.search("[^aeiouy]e$", w)))

    syl = [syllables(w) for w in text_words]
    hard = [w for w in text_words if w not in ("we", "them")]
    assert got["n_syllables"] == sum(syl)
    assert got["n_poly"] == sum(s >= 3 for s in syl)
    assert got["n_difficult"] == len(hard)
    assert got["n_hard"] == sum(syllables(w) >= 3 for w in hard)


def test_corpus_metrics_is_the_sum_of_its_parts(spark, docs):
    words = lex.word_list(
        spark.createDataFrame([("we",), ("our",)], "word string"),
        zipf=spark.createDataFrame(LEXICON, "word string, zipf double"),
    )
    got = by_name(cp.corpus_metrics(docs, "name", words))
    parts = [cp.readability_exact(docs, "name"), cp.readability(docs, "name", words), cp.lexical_stats(docs, "name"), lex.zipf_stats(docs, "name", words)]
    for part in map(by_name, parts):
        for name, row in part.items():
            for column, value in row.items():
                assert got[name][column] == (pytest.approx(value) if isinstance(value, float) else value)
    assert list(cp.corpus_metrics(docs, "name", words).columns) == ["name", *cp.METRICS]
    assert got["empty"]["ari"] is None and got["empty"]["flesch_reading_ease"] is None


def test_formulas_with_published_counts(spark):
    row = dict(n_words=4164, n_sents=160, n_syllables=7646, n_poly=1011, n_hard=972, n_difficult=1794)
    df = spark.createDataFrame([tuple(row.values())], list(row))
    got = df.select(*[e.alias(n) for n, e in rd.word_indices().items()]).first().asDict()
    assert got == pytest.approx(
        dict(
            flesch_reading_ease=25.075820965417876,
            flesch_kincaid_grade=16.22708909702209,
            gunning_fog=19.747175792507207,
            smog_index=17.48930111497398,
            dale_chall=11.730236253602305,
        ),
        abs=1e-9,
    )


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; C</title><style>p{}</style></head><body>
<nav>menu</nav><!-- <p>hidden</p> --><article><h1>One</h1><header>h</header><p>a<b>b</b>&nbsp;&#8217;&#x41;&amp;lt;</p>
<script>var x = "</p>";</script><noscript>no</noscript></article><article>Two</article><footer>foot</footer></body></html>"""


def test_html(spark):
    assert one(spark, pg.html_to_text_content, PAGE) == "One a b ’A&lt; Two"
    assert one(spark, pg.html_to_text_all, PAGE) == "T & C menu One h a b ’A&lt; Two foot"
    assert one(spark, pg.html_to_text_content, "<main>m</main><p>x</p>") == "m"
    assert one(spark, pg.html_to_text_content, "plain <i>t</i><form>f</form>") == "plain t"
    assert one(spark, pg.text_or_html, "no tags") == "no tags"
    assert one(spark, pg.text_or_html, "<P>x</P> y") == "x y"
    assert one(spark, pg.html_to_text_all, "a<script>unclosed") == "a"


@pytest.mark.parametrize(
    ("url", "domain"),
    [
        ("https://www.blog.Example.com:80/a?b#c", "example.com"),
        ("http://user:pw@news.bbc.co.uk/x", "bbc.co.uk"),
        ("forums.example.org/y", "example.org"),
        ("http://127.0.0.1:8080/", "127.0.0.1"),
        ("http://localhost/", "localhost"),
        ("https://co.uk", "co.uk"),
        ("//cdn.example.net/z", "example.net"),
        ("http://a.example.com./", "example.com"),
    ],
)
def test_domain(spark, url, domain):
    assert one(spark, pg.registered_domain, url) == domain


def test_quote_plus(spark):
    assert one(spark, pg.quote_plus, "https://a.b/c d~*é?x=1&y") == "https%3A%2F%2Fa.b%2Fc+d~%2A%C3%A9%3Fx%3D1%26y"


def test_load_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\xff  two\n")
    (tmp_path / "b.MD").write_text("# Title")
    (tmp_path / "c x.html").write_text("<html><body><p>hi</p><nav>n</nav></body></html>")
    (tmp_path / "c x.txt").write_text("last wins")
    (tmp_path / "skip.pdf").write_text("no")
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "d.txt").write_text("deep")
    (sub / "é+1 50%.txt").write_text("name")
    got = {r["name"]: r["text"] for r in sc.load_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a": "one two", "b": "# Title", "c x": "last wins"}
    deep = {r["name"] for r in sc.load_corpus(spark, str(tmp_path), recursive=True).collect()}
    assert deep == {"a", "b", "c x", "d", "é+1 50%"}
    out = sc.clean_folder(spark, str(tmp_path), str(tmp_path / "out"))
    assert {r["name"]: (r["cleaned"], r["clean_words"]) for r in out.collect()} == {
        "a.txt": ("one two", 2), "c x.txt": ("last wins", 2), "d.txt": ("deep", 1),
        "é+1 50%.txt": ("name", 1),
    }


def test_upsert(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1")], "name string, text string")
    b = spark.createDataFrame([("y", "2"), ("z", "2")], "name string, text string")
    assert {r["name"]: r["text"] for r in sc.upsert_corpora(a, b).collect()} == {"x": "1", "y": "2", "z": "2"}


def test_snapshots(spark, tmp_path):
    folder = tmp_path / "site_historical"
    folder.mkdir()
    for name in ("6_9_1999.txt", "10-14-2005.TXT", "02_30_2001.txt", "notes.txt", "x10_03_2010.txt"):
        (folder / name).write_text("some words here. ")
    got = [tuple(r) for r in sn.read_snapshots(spark, str(folder)).drop("text", "date").collect()]
    assert got == [
        ("site_19990609", 1999, "19990609", "6_9_1999.txt"),
        ("site_20051014", 2005, "20051014", "10-14-2005.TXT"),
        ("site_20101003", 2010, "20101003", "x10_03_2010.txt"),
    ]
    words = spark.createDataFrame([("some", True, None, 5.0)], "word string, easy boolean, syllables int, zipf double")
    history = cp.history_metrics(sn.read_snapshots(spark, str(folder)), words)
    assert [r["n_words"] for r in history.collect()] == [3, 3, 3]
    empty = tmp_path / "none_historical"
    empty.mkdir()
    (empty / "notes.txt").write_text("x")
    assert sn.read_snapshots(spark, str(empty)).count() == 0


def test_snapshot_index(spark):
    rows = [
        ('[["timestamp","original","mimetype","statuscode"],["20150101000000","u","t","200"],["20160101000000","u","t","404"]]',),
        ('[["timestamp","original","mimetype","statuscode"]]',),
        ("[]",),
        ("broken",),
    ]
    df = spark.createDataFrame(rows, "response string")
    assert [r["timestamp"] for r in sn.snapshot_index(df, "response").collect()] == ["20150101000000"]
    assert sn.snapshot_index(df, "response", from_year=2016).count() == 0


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_first_last(spark, limit):
    rows = [("u", "2015", t) for t in ("c", "a", "b")] + [("u", "2016", "x"), ("v", "2015", "s"), ("v", "2015", "s")]
    df = spark.createDataFrame(rows, "url string, year string, timestamp string")
    got = sorted(tuple(r) for r in sn.first_last_per_period(df, "url", "year", limit=limit).collect())
    last = [("u", "2015", "c"), ("v", "2015", "s")] if limit > 1 else []
    assert got == sorted([("u", "2015", "a"), ("u", "2016", "x"), ("v", "2015", "s"), *last])


def test_snapshot_label(spark):
    df = spark.createDataFrame([("20150630", "x"), ("bad", "2001-01-01")], "timestamp string, date string")
    assert [r[0] for r in df.select(cp.snapshot_label("timestamp", "date")).collect()] == ["2015-06-30", "2001-01-01"]
