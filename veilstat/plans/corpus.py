"""Corpus jobs: the full metrics record of each document, and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.functions import readability as rd
from veilstat.functions import text as tx
from veilstat.functions.counting import COUNTS, LEXICAL, document_counts
from veilstat.operators.features import median_impute, zscore
from veilstat.operators.lexical import sums_of_items, word_counts, word_sums, zipf_sums
from veilstat.session import cut_lineage
from veilstat.sources.corpus import BROADCAST_BYTES
from veilstat.sources.snapshots import first_last_per_period
from veilstat.spec import quoted

# --- fixed values: the metrics record, in order --------------------------------
METRICS = (
    "n_chars", "n_words", "n_sents", "flesch_reading_ease", "flesch_kincaid_grade",
    "gunning_fog", "smog_index", "dale_chall", "coleman_liau", "ari", "avg_sentence_length",
    "ttr", "yule_k", "entropy", "avg_zipf", "rare_frac", "legalese_frac",
)
_COUNTS = ("n_chars", "n_words", "n_sents", "coleman_liau", "ari", "avg_sentence_length")
_LEXICAL = ("ttr", "yule_k", "entropy", "legalese_frac")


def readability_exact(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Counts and the indices over characters; no word list, no shuffle."""
    c = F.col(quoted(text))
    counted = docs.select(key, *[e.alias(n) for n, e in (tx.basic_counts(c) | tx.index_counts(c)).items()])
    return counted.select(key, "n_chars", "n_words", "n_sents", *[e.alias(n) for n, e in rd.exact_indices().items()])


def readability(docs: DataFrame, key: str, words: DataFrame, text: str = "text") -> DataFrame:
    """The indices over syllables and easy words.

    Words and sentences are counted where the text is read and go along as
    grouping columns, so the text is read once and never shuffled.
    """
    c = F.col(quoted(text))
    counted = docs.select(key, tx.n_sents(c).alias("n_sents"), document_counts(c).alias("_counts"))
    rows = counted.select(key, F.col("_counts.n_words").alias("n_words"), "n_sents", F.explode_outer("_counts.items").alias("_item"))
    per_doc = sums_of_items(
        rows.select(key, "n_words", "n_sents", "_item.*"), _entries(words), [key, "n_words", "n_sents"], word_sums()
    )
    return per_doc.select(key, *[e.alias(n) for n, e in rd.word_indices().items()])


def _entries(words: DataFrame) -> DataFrame:
    """A list of words without zipf values is one whose words are all equally frequent."""
    zipf = F.col("zipf") if "zipf" in words.columns else F.lit(None).cast("double").alias("zipf")
    return words.select("word", "easy", "syllables", zipf)


def lexical_stats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    found = docs.select(key, tx.tokens(F.col(quoted(text))).alias("_tokens"))
    return tx.with_lexical_stats(found, "_tokens").drop("_tokens")


def corpus_metrics(docs: DataFrame, key: str, words: DataFrame, text: str = "text") -> DataFrame:
    """One metrics record per document.

    ``words`` is a list (word, easy, syllables, zipf), see ``word_list``. The
    distinct words and tokens of a document meet it in one pass; what shuffles is
    one partial record per document, and the rare words if the list is long.
    """
    return _metrics(docs, key, words, text).select(key, *METRICS)


def _metrics(docs: DataFrame, key: str, words: DataFrame, text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """Metrics, and ``carried`` columns of the documents; those and what is counted
    in the text travel on one row of a document, the others carry the key and a word."""
    c, carried = F.col(quoted(text)), carried or []
    counted = docs.filter(c.isNotNull()).select(
        key, *carried, F.length(c).cast("bigint").alias("n_chars"), tx.n_sents(c).alias("n_sents"), document_counts(c).alias("_counts")
    )
    wide = counted.withColumns({n: F.col(f"_counts.{n}") for n in (*COUNTS, *LEXICAL)}).withColumns(rd.exact_indices())
    record = [*_COUNTS, *_LEXICAL, *carried]
    no_item = F.lit(None).cast("struct<word:string,n_word:bigint,n_token:bigint>")
    items = F.posexplode(F.concat(F.array(no_item), F.col("_counts.items"))).alias("_pos", "_item")
    rows = wide.select(key, F.struct(*record).alias("_record"), items)
    own = F.when(F.col("_pos") == 0, F.col("_record"))
    rows = rows.select(key, *[own[n].alias(n) for n in record], "_item.*")
    per_doc = sums_of_items(rows, _entries(words), [key], word_sums() | zipf_sums(), record)

    def share(name: str):
        return F.coalesce(F.try_divide(F.col(name).cast("double"), F.col("_tokens").cast("double")), F.lit(0.0))

    return per_doc.withColumns(rd.word_indices() | {"avg_zipf": share("_zipf"), "rare_frac": share("_rare")})


def history_metrics(snapshots: DataFrame, words: DataFrame) -> DataFrame:
    """Metrics of dated snapshots (see ``read_snapshots``) with their dates, by date.

    Two files of one date share their name, so a row is known by a number; its
    fields travel with it and nothing is joined back.
    """
    fields = ["name", "year", "timestamp", "date", "source_file"]
    dated = snapshots.withColumn("year", F.year("date"))
    keyed = dated.select(F.monotonically_increasing_id().alias("_row"), F.struct(*fields).alias("_snapshot"), "text")
    # The texts are read once, so the row numbers need not be kept.
    out = _metrics(keyed, "_row", words, carried=["_snapshot"])
    return out.select(*[f"_snapshot.{c}" for c in fields], *METRICS).orderBy("timestamp", "source_file")


def history_trend(history: DataFrame, *measures: str) -> DataFrame:
    return history.select("timestamp", F.year(_date("timestamp")).alias("year"), *measures).orderBy("timestamp")


def ends_of_periods(snapshots: DataFrame, period_chars: int = 4) -> DataFrame:
    """Snapshots of the first and the last date that a site has in a period.

    The period is the timestamp's beginning: 4 characters for years, 6 for
    months. The dates are counted without the texts; a text is shuffled only if
    the dates wanted do not fit a broadcast.
    """
    site = F.regexp_replace("name", r"_[0-9]{8}$", "")
    placed = snapshots.withColumn("_site", site).withColumn("_period", F.substring("timestamp", 1, period_chars))
    ends = first_last_per_period(placed.select("_site", "_period", "timestamp"), "_site", "_period")
    wanted = cut_lineage(ends.select("_site", "timestamp").distinct())
    size = wanted.agg(F.sum(F.octet_length("_site") + 48)).first()[0] or 0
    picked = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
    return placed.join(picked, ["_site", "timestamp"], "left_semi").drop("_site", "_period")


def trend_of_texts(
    snapshots: DataFrame, words: DataFrame, *measures: str, period_chars: int = 4
) -> DataFrame:
    """Trend of measures over the first and last snapshots of each site and period.

    Only the snapshots at the ends of a period are measured, however many it has.
    """
    measured = history_metrics(ends_of_periods(snapshots, period_chars), words)
    return history_trend(measured, "name", "source_file", *measures)


def snapshot_label(timestamp: str = "timestamp", date: str | None = None):
    """``yyyy-MM-dd`` of a ``yyyyMMdd`` string, else the date column."""
    label = F.date_format(_date(timestamp), "yyyy-MM-dd")
    return F.coalesce(label, F.col(date).cast("string")) if date else label


def _date(column: str):
    return F.try_to_date(F.col(column), "yyyyMMdd")


def history_zscore(history: DataFrame, measures: list[str]) -> DataFrame:
    """Z-scores by snapshot; missing and endless values count as the median."""
    labelled = history.withColumn("snapshot", snapshot_label("timestamp"))
    return zscore(median_impute(labelled, measures), measures).select("snapshot", *measures).orderBy("snapshot")
