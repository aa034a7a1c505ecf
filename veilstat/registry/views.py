"""Input views over the given tables: select lists both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.functions.text import clean_text

QI = """
  c_custkey AS user_id, c_mktsegment AS course_id,
  CASE c_nationkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'IN' WHEN 2 THEN 'BR' WHEN 3 THEN 'AR' ELSE NULL END AS cc_by_ip,
  CASE c_custkey % 3 WHEN 0 THEN 'Boston' WHEN 1 THEN 'Lima' ELSE NULL END AS city,
  CASE WHEN c_custkey % 17 = 0 THEN lpad(CAST((c_custkey * 7919) % 100000 AS STRING), 5, '0') WHEN c_custkey % 2 = 0 THEN '02139' ELSE NULL END AS postalCode,
  CASE c_custkey % 5 WHEN 0 THEN 'Bachelor' WHEN 1 THEN 'High School' WHEN 2 THEN 'Post-Secondary' WHEN 3 THEN 'PhD' ELSE NULL END AS LoE,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '2001' WHEN 2 THEN '1985' ELSE '1990' END AS YoB,
  CASE c_custkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'f' ELSE 'o' END AS gender,
  CASE WHEN c_custkey % 10 < 7 THEN '0' ELSE '12' END AS nforum_posts
"""

QI_WIDE = """
  c_custkey AS user_id, c_mktsegment AS course_id,
  CASE c_nationkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'in ' WHEN 2 THEN 'BR' WHEN 3 THEN 'AR' ELSE NULL END AS cc_by_ip,
  CASE c_custkey % 3 WHEN 0 THEN 'Boston' WHEN 1 THEN 'Lima' ELSE NULL END AS city,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN 'SW1A' ELSE lpad(CAST((c_custkey * 7919) % 100000 AS STRING), 5, '0') END AS postalCode,
  CASE c_custkey % 8 WHEN 0 THEN 'Bachelor' WHEN 1 THEN 'High School' WHEN 2 THEN 'Post-Secondary' WHEN 3 THEN 'Master' WHEN 4 THEN 'PhD' WHEN 5 THEN 'unknown' WHEN 6 THEN 'Associate' ELSE NULL END AS LoE,
  CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '2001-05-17' WHEN 2 THEN 'x' ELSE CAST(1960 + (c_custkey * 13) % 55 AS STRING) END AS YoB,
  CASE c_custkey % 6 WHEN 0 THEN 'm' WHEN 1 THEN 'F' WHEN 2 THEN 'o' WHEN 3 THEN ' male' WHEN 4 THEN NULL ELSE 'f' END AS gender,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey * 31 % 27 AS STRING) END AS nforum_posts
"""

IDS = ("user_id", "course_id")
QIS = ("cc_by_ip", "city", "postalCode", "LoE", "YoB", "gender", "nforum_posts")

# An archive index out of the event log: one response per event, a header row
# and the event. Errors play the failed fetches.
INDEX_RESPONSE = """
  to_json(array(
    array('timestamp', 'original', 'mimetype', 'statuscode'),
    array(date_format(ts, 'yyyyMMddHHmmss'), concat('user/', user_id), event_type,
          CASE WHEN event_type = 'error' THEN '500' ELSE '200' END))) AS response
"""

# Months of orders play the dated snapshots of a history.
HISTORY = """
  date_format(date_trunc('month', o_orderdate), 'yyyyMMdd') AS timestamp,
  o_totalprice AS price, o_orderkey AS orderkey
"""


# Days made from ids; ten ids share a day, so names occur again.
DATED = """
  doc_id, text, date_add(DATE '2000-01-01', CAST(doc_id DIV 200 AS INT)) AS date,
  date_format(date_add(DATE '2000-01-01', CAST(doc_id DIV 200 AS INT)), 'yyyyMMdd') AS timestamp,
  concat(source, '_', date_format(date_add(DATE '2000-01-01', CAST(doc_id DIV 200 AS INT)), 'yyyyMMdd')) AS name,
  concat('d', doc_id, '.txt') AS source_file
"""


# Suffix rules of the three kinds, one country a nation, and addresses of customers under them.
SUFFIX_RULES = """
  SELECT concat('co.nation-', n_nationkey) AS value FROM {nation} WHERE n_nationkey % 3 = 0
  UNION ALL SELECT concat('*.nation-', n_nationkey) FROM {nation} WHERE n_nationkey % 3 <> 0
  UNION ALL SELECT concat('!www.nation-', n_nationkey) FROM {nation} WHERE n_nationkey % 3 = 2
"""
ADDRESSES = """
  c_custkey, concat('http://',
    CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'www.' WHEN 2 THEN 'a.www.' WHEN 3 THEN 'co.' WHEN 4 THEN 'shop.b.co.'
      WHEN 5 THEN concat('c', c_custkey % 50, '.') ELSE concat('x.y', c_custkey % 50, '.z.') END,
    'nation-', c_nationkey, '/page') AS url
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _select(df: DataFrame, columns: str) -> DataFrame:
    return df.sparkSession.sql(f"SELECT {columns} FROM {{src}}", src=df)


def qi(spark: SparkSession, sf: str) -> DataFrame:
    return _select(table(spark, sf, "customer"), QI)


def qi_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _select(table(spark, sf, "customer"), QI_WIDE)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text) with clean text."""
    return table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def index_responses(spark: SparkSession, sf: str) -> DataFrame:
    return _select(table(spark, sf, "events"), INDEX_RESPONSE)


def dated_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as snapshots: a source's document of every day, days made from the ids."""
    docs = table(spark, sf, "documents").select("doc_id", "source", clean_text(F.col("text")).alias("text"))
    return _select(docs, DATED)


def suffix_rules(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(SUFFIX_RULES.format(nation="{nation}"), nation=table(spark, sf, "nation"))


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    return _select(table(spark, sf, "customer"), ADDRESSES)


def history(spark: SparkSession, sf: str) -> DataFrame:
    """One row per month: orders, mean price, mean key."""
    rows = _select(table(spark, sf, "orders"), HISTORY)
    return rows.groupBy("timestamp").agg(
        F.count(F.lit(1)).alias("n_words"), F.avg("price").alias("flesch_kincaid_grade")
    )
