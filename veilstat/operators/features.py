"""Feature columns: selection, exact medians, z-scores, description."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat import lexicons as lx
from veilstat.operators.quantiles import exact_quantiles
from veilstat.spec import quoted


def select_features(
    df: DataFrame, wanted: Sequence[str] = lx.FEATURES
) -> tuple[list[str], list[str]]:
    """The wanted columns which exist, and those which do not."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]


def finite(name: str):
    """The number, null where it is missing or without end."""
    x = F.col(quoted(name)).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and infinite values replaced by the exact median of the column."""
    usable = df.withColumns({c: finite(c) for c in columns})
    medians = exact_quantiles(usable, columns, [0.5])
    return usable.withColumns(
        {c: F.coalesce(F.col(quoted(c)), F.lit(medians[c][0]).cast("double")) for c in columns}
    )


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population standard deviation; 0 in a constant column.

    The moments are one scalar subquery over all columns, so rows stay where
    they are.
    """
    moments = []
    for i, c in enumerate(columns):
        x = F.col(quoted(c)).cast("double")
        moments += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    table = df.agg(*moments)
    stats = table.select(F.struct(*table.columns).alias("stats")).scalar()
    scaled = df.withColumn("_stats", stats)

    def score(i: int, c: str):
        centred = F.col(quoted(c)).cast("double") - F.col(f"_stats.m{i}")
        flat = F.col(f"_stats.s{i}") == 0
        return F.when(flat & centred.isNotNull(), 0.0).otherwise(F.try_divide(centred, F.col(f"_stats.s{i}")))

    return scaled.withColumns({c: score(i, c) for i, c in enumerate(columns)}).drop("_stats")


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum."""
    x = F.col(quoted(column)).cast("double")
    numbers = df.select(x.alias("x"))
    q25, q50, q75 = exact_quantiles(numbers, ["x"], [0.25, 0.5, 0.75])["x"]
    return numbers.agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.lit(q25).cast("double").alias("q25"),
        F.lit(q50).cast("double").alias("q50"),
        F.lit(q75).cast("double").alias("q75"),
        F.max("x").alias("max"),
    )
