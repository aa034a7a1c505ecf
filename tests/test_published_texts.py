"""Published metrics of seven texts, where the texts are at hand.

Point PUBLISHED_TEXTS to a folder with current texts and PUBLISHED_HISTORY to
one with dated ones; else these tests are skipped.
"""

import os

import pytest
from pyspark.sql import functions as F

from veilstat.functions import text as tx
from veilstat.plans import corpus as cp
from veilstat.sources.corpus import load_corpus
from veilstat.sources.snapshots import read_snapshots

CURRENT, HISTORY = os.environ.get("PUBLISHED_TEXTS"), os.environ.get("PUBLISHED_HISTORY")
pytestmark = pytest.mark.skipif(not (CURRENT and HISTORY), reason="texts are not part of this repository")

# n_chars, n_words, n_sents, avg_sentence_length, ttr, yule_k, entropy, legalese_frac, coleman_liau, ari, syllables
PUBLISHED = {
    "google_19990609": (5072, 818, 38, 21.526315789473685, 0.4155363748458693, 89.94695319139879, 7.576301671894326, 0.011097410604192354, 11.83911980440098, 13.480440503432497, 1332),
    "google_20051014": (13258, 2055, 80, 25.6875, 0.28948655256723715, 92.29021825551018, 7.90844950797025, 0.010268948655256724, 13.743941605839414, 16.756632579403274, 3703),
    "google_20101003": (12068, 1852, 73, 25.36986301369863, 0.31094257854821233, 88.38764732741814, 7.92997756687839, 0.010834236186348862, 14.06889848812095, 16.76555351641869, 3336),
    "google_20150630": (25315, 3990, 159, 25.09433962264151, 0.2132334581772784, 94.6644409843501, 8.074231421089062, 0.006741573033707865, 12.995839598997492, 15.841472452643885, 6870),
    "amazon": (27478, 4164, 160, 26.025, 0.2192919933475885, 93.47650818503675, 8.219078940060168, 0.0042765502494654314, 14.539193083573487, 17.644276034236803, 7646),
    "apple": (29703, 4637, 200, 23.185, 0.20290771175726927, 99.28382034934735, 8.113057145437917, 0.009481668773704172, 13.362993314643091, 15.207038494257766, 8448),
    "tiktok": (29995, 4621, 187, 24.711229946524064, 0.1917691981332202, 114.01868687841433, 7.959119946710777, 0.0067882901994060245, 13.740532352304701, 16.579070808207227, 8236),
}


def test_published_metrics(spark):
    docs = load_corpus(spark, CURRENT).unionByName(read_snapshots(spark, HISTORY, "google").select("name", "text"))
    words = spark.createDataFrame([], "word string, easy boolean, syllables int, zipf double")
    metrics = {r["name"]: r for r in cp.corpus_metrics(docs, "name", words).collect()}
    counted = docs.select("name", F.explode(tx.words(F.col("text"))).alias("w")).groupBy("name")
    syllables = {r["name"]: r["s"] for r in counted.agg(F.sum(tx.syllables(F.col("w"))).alias("s")).collect()}
    names = ("n_chars", "n_words", "n_sents", "avg_sentence_length", "ttr", "yule_k", "entropy", "legalese_frac", "coleman_liau", "ari")
    for name, want in PUBLISHED.items():
        assert [metrics[name][c] for c in names] == pytest.approx(list(want[:10]), abs=1e-9)
        assert syllables[name] == pytest.approx(want[10], rel=0.03)
