"""Record tables in CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstat import lexicons as lx
from veilstat.functions.generalize import na_normalize
from veilstat.operators.lexical import lookup
from veilstat.session import cut_lineage
from veilstat.spec import quoted


def read_records(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    na_tokens: Sequence[str] = lx.NA_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """CSV files with headers. Every value is text, so postal codes keep their zeros.

    Without ``columns`` the names come from the first header. Every file's own
    header is held against the names, so a file with another order of columns
    fails the read and is not taken in swapped. ``multi_line`` reads values with
    line breaks; a file is then one task.
    """
    options = {"header": True, "nullValue": "", "multiLine": multi_line, "escape": '"'}
    if columns is None:
        columns = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).options(**options, enforceSchema=False, columnPruning=False).csv(path)
    return raw.select(*[na_normalize(F.col(quoted(c)), na_tokens).alias(c) for c in columns])


def read_records_by_header(
    spark: SparkSession, path: str, columns: Sequence[str], na_tokens: Sequence[str] = lx.NA_TOKENS
) -> DataFrame:
    """CSV files below a folder, each with these columns in an order of its own.

    A file's first line tells its order; rows meet it by the file's path, and a
    file with a third of all rows stays where it is read (``lookup``). A line
    that repeats its file's header is no record. A file whose first line is not
    made of these names fails the read.
    """
    fields = [f"c{i}" for i in range(len(columns))]
    reader = spark.read.schema(", ".join(f"{f} string" for f in fields)).options(
        header=False, nullValue="", escape='"', recursiveFileLookup=True, mode="FAILFAST"
    )
    cells = F.array(*fields).alias("_cells")
    lines = reader.csv(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), cells
    )
    # Line numbers grow within a block, and a file's first block begins at 0.
    first = lines.filter("_start = 0").select("_file", "_cells", F.monotonically_increasing_id().alias("_line"))
    order = first.groupBy("_file").agg(F.min_by("_cells", "_line").alias("_order"))
    names = F.array(*[F.lit(c) for c in columns])
    fits = F.sort_array("_order") == F.sort_array(names)
    known = cut_lineage(order.select("_file", F.when(fits, F.col("_order")).alias("_order")))
    rows = lookup(lines.drop("_start"), known, "_file")
    checked = F.coalesce("_order", F.raise_error(F.concat(F.lit("another header in "), "_file")).cast("array<string>"))
    kept = rows.withColumn("_order", checked).filter("NOT _cells <=> _order")
    values = [F.get("_cells", F.array_position("_order", F.lit(c)).cast("int") - 1) for c in columns]
    return kept.select(*[na_normalize(x, na_tokens).alias(c) for x, c in zip(values, columns)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)
