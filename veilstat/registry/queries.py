"""One callable (spark, sf_dir) -> DataFrame per registered query."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat import lexicons as lx
from veilstat.functions import generalize as gz
from veilstat.functions import pages as pg
from veilstat.functions import text as tx
from veilstat.operators import classes as cl
from veilstat.operators import domains as dm
from veilstat.operators import features as ft
from veilstat.operators import learn as ln
from veilstat.operators import lexical as lex
from veilstat.operators import neighbors as nb
from veilstat.operators import suppress as sp
from veilstat.operators import textsim as ts
from veilstat.plans import corpus as cp
from veilstat.plans import deid
from veilstat.plans import similarity as sim
from veilstat.registry import views as v
from veilstat.session import cut_lineage, ensure_checkpoint_dir
from veilstat.sources import corpus as sc
from veilstat.sources import records as rc
from veilstat.sources import snapshots as sn
from veilstat.spec import QISpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Words this frequent count as easy; at most 10**4 words can reach it.
EASY_ZIPF = 5.0


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison with another engine.

    Values like 12.0325625 come out one bit apart in two engines and would
    round to both sides, so halves are led upwards. Negative zero becomes zero.
    """
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) + 0.0 for c in columns})


# --- classes and suppression -------------------------------------------------------


@query
def k_level(spark: SparkSession, sf: str) -> DataFrame:
    return cl.k_level(v.qi(spark, sf), v.QIS)


@query
def k_level_per_column(spark: SparkSession, sf: str) -> DataFrame:
    return cl.k_level_per_column(v.qi(spark, sf), v.QIS)


@query
def class_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return cl.class_sizes(v.qi(spark, sf), v.QIS)


@query
def qi_cardinality_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Exact counts, and whether the merged sketches of all return flags and states are within four standard errors."""
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"]
    lines = v.table(spark, sf, "lineitem")
    stored = cut_lineage(cl.cardinality_sketches(lines, columns, ["l_returnflag", "l_linestatus"]))
    guessed = cl.sketched_cardinality(stored, columns).withColumnRenamed("cardinality", "guess")
    both = cl.qi_cardinality(lines, columns).join(F.broadcast(guessed), "column")
    error = 4 * 1.04 / 2 ** (cl.SKETCH_BITS / 2)
    near = F.abs(F.col("guess") - F.col("cardinality")) <= F.col("cardinality") * error
    return both.select("column", "cardinality", near.cast("int").alias("within_bound"))


@query
def records_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as CSV files with two orders of columns, and read by their headers."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    columns = [*v.IDS, *v.QIS]
    records = v.qi(spark, sf).select(*columns)
    rc.write_csv(records.filter("user_id % 2 = 0"), f"{folder}/even")
    rc.write_csv(records.filter("user_id % 2 = 1").select(*columns[::-1]), f"{folder}/odd")
    return rc.read_records_by_header(spark, folder, columns)


@query
def class_count(spark: SparkSession, sf: str) -> DataFrame:
    return cl.class_count(v.qi(spark, sf), v.QIS)


@query
def rare_classes(spark: SparkSession, sf: str) -> DataFrame:
    return cl.rare_classes(v.qi(spark, sf), v.QIS)


@query
def qi_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return cl.qi_cardinality(v.qi(spark, sf), v.QIS)


@query
def suppression_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sp.suppression_summary(v.qi(spark, sf), v.QIS)


@query
def record_class_size(spark: SparkSession, sf: str) -> DataFrame:
    return cl.record_class_size(v.qi(spark, sf), v.QIS)


@query
def record_suppression(spark: SparkSession, sf: str) -> DataFrame:
    return sp.record_suppression(v.qi(spark, sf), v.QIS)


@query
def violating_records(spark: SparkSession, sf: str) -> DataFrame:
    return cl.violating_records(v.qi(spark, sf), v.QIS)


@query
def greedy_column_suppression(spark: SparkSession, sf: str) -> DataFrame:
    df = v.qi(spark, sf)
    return sp.greedy_column_suppression(df, QISpec.of(df)).log(df)


@query
def column_suppression_project(spark: SparkSession, sf: str) -> DataFrame:
    """The columns that are left depend on the records, so each value is a row."""
    df = v.qi(spark, sf)
    kept = sp.column_suppression(df, QISpec.of(df))
    kept = df.limit(0) if kept is None else kept
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in kept.columns if c not in v.IDS]
    return kept.select(*v.IDS, F.inline(F.array(*cells)))


@query
def describe_column(spark: SparkSession, sf: str) -> DataFrame:
    out = ft.describe(v.qi_wide(spark, sf), "nforum_posts")
    return rounded(out, "mean", "std", "min", "q25", "q50", "q75", "max")


# --- generalization --------------------------------------------------------------------


def _wide(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    return v.qi_wide(spark, sf).select("user_id", *[e.alias(c) for c, e in columns.items()])


@query
def na_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, **{c: gz.na_normalize(F.col(c)) for c in v.QIS})


@query
def generalize_birth(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, birth=gz.birth_bucket(F.col("YoB")))


@query
def generalize_country(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, country=gz.hemisphere(F.col("cc_by_ip")))


@query
def generalize_city(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, city=gz.hemisphere_city(gz.hemisphere(F.col("cc_by_ip"))))


@query
def generalize_postal(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, postal=gz.postal_binary(F.col("postalCode")))


@query
def generalize_postal_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, postal=gz.postal_prefix(F.col("postalCode")))


@query
def generalize_education(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, education=gz.education_binary(F.col("LoE")))


@query
def generalize_counter(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, posts=gz.counter_binary(F.col("nforum_posts")))


@query
def generalize_counter_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, posts=gz.counter_bins(F.col("nforum_posts")))


@query
def generalize_gender(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, gender=gz.gender_normalized(F.col("gender")))


@query
def generalize_all(spark: SparkSession, sf: str) -> DataFrame:
    return gz.generalize(v.qi_wide(spark, sf))


@query
def generalize_then_suppress(spark: SparkSession, sf: str) -> DataFrame:
    return deid.generalize_then_suppress(v.qi_wide(spark, sf))


@query
def combination(spark: SparkSession, sf: str) -> DataFrame:
    return deid.combination(v.qi_wide(spark, sf))[1]


@query
def combination_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that the combination keeps, by their identifiers."""
    return deid.combination(v.qi_wide(spark, sf))[0].select(*v.IDS)


# --- text --------------------------------------------------------------------------------


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return v.documents(spark, sf)


@query
def basic_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = tx.basic_counts(F.col("text"))
    return v.documents(spark, sf).select("doc_id", *[e.alias(n) for n, e in counts.items()])


@query
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array_join(tx.tokens(F.col("text")), " ")
    return v.documents(spark, sf).select("doc_id", found.alias("tokens"))


@query
def token_freq(spark: SparkSession, sf: str) -> DataFrame:
    return lex.token_freq(v.documents(spark, sf), "doc_id")


@query
def lexical_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = cp.lexical_stats(v.documents(spark, sf), "doc_id")
    return rounded(out, "ttr", "yule_k", "entropy", "legalese_frac")


@query
def readability_exact(spark: SparkSession, sf: str) -> DataFrame:
    out = cp.readability_exact(v.documents(spark, sf), "doc_id")
    return rounded(out, "coleman_liau", "ari", "avg_sentence_length")


@query
def syllable_counts(spark: SparkSession, sf: str) -> DataFrame:
    word = F.explode(tx.words(F.col("text"))).alias("word")
    distinct = v.documents(spark, sf).select(word).distinct()
    return distinct.select("word", tx.syllables(F.col("word")).alias("syllables"))


def _lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Zipf values of the corpus itself, written once and read by all that follows."""
    return cut_lineage(lex.zipf_lexicon(v.documents(spark, sf), "doc_id"))


def _words(lexicon: DataFrame) -> DataFrame:
    """Frequent words count as easy; syllables are counted once per word of the list."""
    easy = F.when(F.col("zipf") >= EASY_ZIPF, True)
    return lexicon.select("word", "zipf", easy.alias("easy"), tx.syllables(F.col("word")).alias("syllables"))


@query
def readability(spark: SparkSession, sf: str) -> DataFrame:
    out = cp.readability(v.documents(spark, sf), "doc_id", _words(_lexicon(spark, sf)))
    return rounded(
        out, "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "smog_index", "dale_chall"
    )


@query
def zipf_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return lex.zipf_lexicon(v.documents(spark, sf), "doc_id")


@query
def zipf_stats(spark: SparkSession, sf: str) -> DataFrame:
    # The lexicon of one table meets the texts of another, so that words are missing.
    turns = v.table(spark, sf, "conversations")
    docs = turns.select(F.concat_ws("/", "conv_id", "turn").alias("turn_id"), "text")
    out = lex.zipf_stats(docs, "turn_id", _lexicon(spark, sf))
    return rounded(out, "avg_zipf", "rare_frac")


@query
def clean_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return lex.clean_corpus(v.documents(spark, sf), "doc_id")


@query
def clean_tokens_vocab(spark: SparkSession, sf: str) -> DataFrame:
    turns = v.table(spark, sf, "conversations")
    vocabulary = cut_lineage(lex.zipf_lexicon(turns, "conv_id"))
    return lex.clean_corpus(v.documents(spark, sf), "doc_id", lexicon=vocabulary)


@query
def corpus_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = cp.corpus_metrics(v.documents(spark, sf), "doc_id", _words(_lexicon(spark, sf)))
    return rounded(out, *cp.METRICS[3:])


@query
def corpus_upsert(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id") % 50).alias("name"), "text")
    items = v.table(spark, sf, "benchmark").select(F.concat(F.lit("src1/"), "item_id").alias("name"), "text")
    return sc.upsert_corpora(docs, items)


# --- pages ---------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    return v.pages(spark, sf).select("page_id", *[e.alias(c) for c, e in columns.items()])


@query
def html_sniff(spark: SparkSession, sf: str) -> DataFrame:
    pages = v.pages(spark, sf).select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    docs = v.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return pages.unionByName(docs).select(
        "id", pg.is_html(F.col("text")).cast("int").alias("is_html"), pg.text_or_html(F.col("text")).alias("text")
    )


def _text_folder(spark: SparkSession, sf: str) -> str:
    """Documents as text files; of odd ones all but ASCII is written in another encoding where it can be."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/texts-{uuid.uuid4().hex}"
    narrow = (F.col("doc_id") % 2 == 1) & ~F.col("text").rlike(r"[^\u0000-\u00ff]")
    other = F.encode("text", "ISO-8859-1").cast("string")
    docs = v.table(spark, sf, "documents")
    sc.write_texts(docs.select("doc_id", F.when(narrow, other).otherwise(F.col("text")).alias("text")), folder, "doc_id")
    return folder


@query
def text_files_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return sc.read_texts(spark, _text_folder(spark, sf))


@query
def html_to_text_all(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf, text=pg.html_to_text_all(F.col("html")))


@query
def html_to_text_content(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf, text=pg.html_to_text_content(F.col("html")))


@query
def registered_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf, domain=pg.registered_domain(F.col("url")))


@query
def registered_domain_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = dm.suffix_rules(v.suffix_rules(spark, sf))
    return dm.domains_by_rules(v.addresses(spark, sf), "url", rules).select("c_custkey", "domain")


@query
def url_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf, encoded=pg.quote_plus(F.concat("url", F.lit(" ~*"))))


@query
def page_to_document(spark: SparkSession, sf: str) -> DataFrame:
    return sc.pages_to_documents(v.pages(spark, sf), "page_id")


# --- snapshots and history ---------------------------------------------------------------------


@query
def snapshot_date_parse(spark: SparkSession, sf: str) -> DataFrame:
    orders = v.table(spark, sf, "orders")
    files = orders.select("o_orderkey", F.concat(F.date_format("o_orderdate", "MM_dd_yyyy"), F.lit(".TXT")).alias("file"))
    stamped = sn.with_snapshot_fields(files, F.lit("site"))
    return stamped.withColumn("date", F.col("date").cast("string"))


@query
def snapshot_index(spark: SparkSession, sf: str) -> DataFrame:
    return sn.snapshot_index(v.index_responses(spark, sf), "response", 2015, 2025)


@query
def first_last_per_period(spark: SparkSession, sf: str) -> DataFrame:
    index = sn.snapshot_index(v.index_responses(spark, sf), "response", 2015, 2025)
    daily = index.withColumn("day", F.substring("timestamp", 1, 8))
    return sn.first_last_per_period(daily, "original", "day")


@query
def history_trend(spark: SparkSession, sf: str) -> DataFrame:
    out = cp.history_trend(v.history(spark, sf), "n_words", "flesch_kincaid_grade")
    return rounded(out, "flesch_kincaid_grade")


@query
def history_trend_texts(spark: SparkSession, sf: str) -> DataFrame:
    """First and last day of a source in each month, measured from the texts."""
    measures = ["n_words", "flesch_kincaid_grade", "entropy"]
    words = _words(_lexicon(spark, sf))
    out = cp.trend_of_texts(v.dated_documents(spark, sf), words, *measures, period_chars=6)
    return rounded(out, *measures[1:])


@query
def history_zscore(spark: SparkSession, sf: str) -> DataFrame:
    measures = ["n_words", "flesch_kincaid_grade"]
    return rounded(cp.history_zscore(v.history(spark, sf), measures), *measures)


@query
def history_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = cp.history_metrics(v.dated_documents(spark, sf), _words(_lexicon(spark, sf)))
    return rounded(out.withColumn("date", F.col("date").cast("string")), *cp.METRICS[3:])


@query
def history_zscore_features(spark: SparkSession, sf: str) -> DataFrame:
    """All fifteen features, with missing values and endless ones among them."""
    metrics = cp.corpus_metrics(v.documents(spark, sf), "doc_id", _words(_lexicon(spark, sf)))
    day = F.date_format(F.date_add(F.lit("2000-01-01"), F.col("doc_id").cast("int")), "yyyyMMdd")
    gaps = metrics.withColumn("timestamp", day).withColumns(
        {
            "ari": F.when(F.col("n_words") >= 20, F.col("ari")),
            "yule_k": F.when(F.col("n_words") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("yule_k")),
        }
    )
    out = cp.history_zscore(cut_lineage(gaps), list(lx.FEATURES))
    return rounded(out, *lx.FEATURES)


# --- features --------------------------------------------------------------------------------------


def _document_features(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics with gaps: texts below twenty words have no ``ari``."""
    docs = v.documents(spark, sf)
    out = cp.readability_exact(docs, "doc_id")
    gap = F.when(F.col("n_words") >= 20, F.col("ari"))
    with_gaps = out.withColumn("ari", gap).select("doc_id", "n_words", "n_sents", "coleman_liau", "ari")
    # Read several times by the medians; much smaller than the texts.
    return cut_lineage(with_gaps)


_FEATURES = ["n_words", "n_sents", "coleman_liau", "ari"]


@query
def median_impute(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.median_impute(_document_features(spark, sf), _FEATURES), *_FEATURES)


@query
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    features = ft.median_impute(_document_features(spark, sf), _FEATURES)
    return rounded(ft.zscore(features, _FEATURES), *_FEATURES)


# --- neighbours and clusters -------------------------------------------------------------------------


@query
def nearest_overall(spark: SparkSession, sf: str) -> DataFrame:
    out = nb.nearest(v.table(spark, sf, "embeddings"), "vec_id", "embedding")
    return rounded(out, "distance", digits=4)


@query
def nearest_features(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest documents in two standardized measures, where most cells are pruned."""
    measures = ["coleman_liau", "ari"]
    scaled = ft.zscore(ft.median_impute(_document_features(spark, sf), measures), measures)
    points = rounded(scaled, *measures).select("doc_id", F.array(*measures).alias("v"))
    return rounded(nb.nearest(cut_lineage(points), "doc_id", "v"), "distance", digits=4)


@query
def nearest_same_cluster(spark: SparkSession, sf: str) -> DataFrame:
    out = nb.nearest(v.table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return rounded(out, "distance", digits=4)


@query
def nearest_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return nb.neighbor_report(v.table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


@query
def cluster_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    return nb.prototype_report(v.table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


@query
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    value = ln.silhouette(v.table(spark, sf, "embeddings"), "embedding", "label")
    out = spark.range(1).select(F.lit(value).cast("double").alias("silhouette"))
    return rounded(out, "silhouette")


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """The embedding as columns."""
    vectors = v.table(spark, sf, "embeddings")
    dims = vectors.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"x{i}" for i in range(dims)]
    return vectors.select("vec_id", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)]), names


@query
def pca2(spark: SparkSession, sf: str) -> DataFrame:
    wide, names = _vectors(spark, sf)
    points = ln.project(ft.zscore(wide, names), "vec_id", names)
    out = points.select("vec_id", F.col("point")[0].alias("pc1"), F.col("point")[1].alias("pc2"))
    return rounded(out, "pc1", "pc2")


@query
def kmeans4(spark: SparkSession, sf: str) -> DataFrame:
    wide, names = _vectors(spark, sf)
    points = ln.project(ft.zscore(wide, names), "vec_id", names)
    return ln.cluster(points, "point", key="vec_id").select("vec_id", "cluster_label")


@query
def document_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """From texts to clusters: metrics, projection, k-means, neighbours and prototypes."""
    metrics = cp.corpus_metrics(v.documents(spark, sf), "doc_id", _words(_lexicon(spark, sf)))
    neighbors, prototypes = sim.similarity_reports(metrics, "doc_id", digits=6)
    chosen = prototypes.select(F.col("prototype").alias("doc_id"), F.lit(1).alias("is_prototype"))
    return neighbors.join(F.broadcast(chosen), "doc_id", "left").fillna(0, ["is_prototype"])


@query
def kmeans4_settled(spark: SparkSession, sf: str) -> DataFrame:
    """Points, clusters, and points that are nearer to the mean of another cluster.

    What can be told of a k-means result without its labels: none is.
    """
    wide, names = _vectors(spark, sf)
    points = cut_lineage(ln.project(ft.zscore(wide, names), "vec_id", names))
    labelled = cut_lineage(ln.cluster(points, "point"))
    centers = nb.cluster_centroids(labelled, "point", "cluster_label").withColumnRenamed("cluster_label", "c")
    handful = F.broadcast(centers.agg(F.collect_list(F.struct("c", "centroid")).alias("centers")))
    x, y = F.col("point")[0], F.col("point")[1]

    def away(c: Column) -> Column:
        return F.pow(x - c["centroid"][0], 2) + F.pow(y - c["centroid"][1], 2)

    met = labelled.join(handful)
    own = F.array_min(F.transform(F.filter("centers", lambda c: c["c"] == F.col("cluster_label")), away))
    least = F.array_min(F.transform("centers", away))
    return met.agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_distinct("cluster_label").alias("n_clusters"),
        F.count(F.when(own > least + 1e-3, 1)).alias("misplaced"),
    )


@query
def text_top2_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return ts.top2_neighbors(v.documents(spark, sf), "doc_id")
