"""Dated snapshots: files named by date, and archive indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.sources.corpus import TXT_FILES, read_files

# --- fixed values: file names and index rows --------------------------------------
DATED_FILE = r"(?i)([0-9]{1,2})[_-]([0-9]{1,2})[_-]([0-9]{4})\.txt$"
FOLDER_SUFFIX = "_historical"
INDEX_FIELDS = ("timestamp", "original", "mimetype", "statuscode")


def snapshot_date(file: Column) -> Column:
    """Date in a name like ``6_9_1999.txt`` (month first), else null."""
    month, day, year = (F.regexp_extract(file, DATED_FILE, i) for i in (1, 2, 3))
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")


def with_snapshot_fields(files: DataFrame, site: Column) -> DataFrame:
    """Add name, year, timestamp and date to (file, ...); undated files go."""
    dated = files.withColumn("date", snapshot_date(F.col("file"))).filter("date IS NOT NULL")
    stamped = dated.withColumn("timestamp", F.date_format("date", "yyyyMMdd"))
    return stamped.withColumns(
        {"name": F.concat_ws("_", site, "timestamp"), "year": F.year("date")}
    ).withColumnRenamed("file", "source_file")


def read_snapshots(spark: SparkSession, folder: str, site: str | None = None) -> DataFrame:
    """Dated text files of one site, as they are, by date."""
    if site is None:
        site = folder.rstrip("/").rsplit("/", 1)[-1].replace(FOLDER_SUFFIX, "")
    files = read_files(spark, folder, TXT_FILES)
    stamped = with_snapshot_fields(files, F.lit(site))
    return stamped.select("name", "text", "year", "timestamp", "date", "source_file").orderBy("timestamp")


def snapshot_index(
    responses: DataFrame,
    json: str,
    from_year: int | None = None,
    to_year: int | None = None,
    status: str = "200",
) -> DataFrame:
    """Rows of index responses, each a JSON array of arrays led by a header."""
    table = F.from_json(F.col(json), "array<array<string>>")
    body = F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0)))
    rows = responses.select(F.explode(body).alias("r")).select(
        *[F.try_element_at("r", F.lit(i + 1)).alias(n) for i, n in enumerate(INDEX_FIELDS)]
    )
    year = F.substring("timestamp", 1, 4).try_cast("int")
    kept = rows.filter(F.col("statuscode") == status).withColumn("year", year)
    if from_year is not None:
        kept = kept.filter(F.col("year") >= from_year)
    if to_year is not None:
        kept = kept.filter(F.col("year") <= to_year)
    return kept


def first_last_per_period(
    index: DataFrame, key: str, period: str, ts: str = "timestamp", limit: int = 2
) -> DataFrame:
    """First and last timestamp of each (key, period), at most ``limit`` of them.

    A period with one row gives that row; two rows with the same timestamp give
    it twice. Minimum, maximum and count say all that is needed, so a busy key
    is not sorted in one task.
    """
    ends = index.groupBy(key, period).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    picks = F.when(F.col("_n") == 1, F.array("_first")).otherwise(F.array("_first", "_last"))
    return ends.select(key, period, F.explode(F.slice(picks, 1, limit)).alias(ts))
