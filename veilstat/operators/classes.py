"""Equivalence classes of quasi-identifiers.

A class is a group of rows equal on every quasi-identifier, null equal to null.
Counts are aggregated before the shuffle, so a class holding a third of all
rows costs one row per map task. Nothing here windows over a class.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstat.session import cut_lineage
from veilstat.spec import quoted

# A class is hot when it holds more than 1/HOT_SHARE of all rows, so there are
# fewer than HOT_SHARE hot classes, whatever the size of the table.
HOT_SHARE = 4096


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(quoted(c)) for c in names]


def class_sizes(df: DataFrame, qis: Sequence[str], name: str = "n") -> DataFrame:
    """Class -> number of rows."""
    return df.groupBy(*_cols(qis)).agg(F.count(F.lit(1)).alias(name))


def k_level(df: DataFrame, qis: Sequence[str] | str) -> DataFrame:
    """One row, ``k``: size of the smallest class; all rows when there is no QI; 0 when empty."""
    qis = [qis] if isinstance(qis, str) else list(qis)
    if not qis:
        return df.agg(F.count(F.lit(1)).alias("k"))
    return class_sizes(df, qis).agg(F.coalesce(F.min("n"), F.lit(0)).alias("k"))


def k_value(df: DataFrame, qis: Sequence[str] | str) -> int:
    return k_level(df, qis).first()["k"]


def column_profile(df: DataFrame, qis: Sequence[str], count_na: bool = True) -> DataFrame:
    """Per column, in one scan: ``k`` of the column alone and its ``cardinality``.

    One grouping set per column; partial aggregation runs inside each set.
    """
    sets = [_cols([c]) for c in qis]
    groups = df.groupingSets(sets, *_cols(qis)).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_n")
    )
    labels, is_null = F.lit(None).cast("string"), F.lit(False)
    for i, c in enumerate(qis):
        # Every column but the i-th is grouped out of its set.
        gid = (1 << len(qis)) - 1 - (1 << (len(qis) - 1 - i))
        labels = F.when(F.col("_gid") == gid, c).otherwise(labels)
        is_null = F.when(F.col("_gid") == gid, F.col(quoted(c)).isNull()).otherwise(is_null)
    counted = F.lit(1) if count_na else F.when(~is_null, 1)
    return (
        groups.select(labels.alias("column"), "_n", counted.alias("_counted"))
        .groupBy("column")
        .agg(F.min("_n").alias("k"), F.count("_counted").alias("cardinality"))
    )


def k_level_per_column(df: DataFrame, qis: Sequence[str]) -> DataFrame:
    return column_profile(df, qis).select("column", "k")


def qi_cardinality(df: DataFrame, qis: Sequence[str], count_na: bool = True) -> DataFrame:
    return column_profile(df, qis, count_na).select("column", "cardinality")


#: Sketches have 2 ** SKETCH_BITS registers; the standard error is 1.04 over the root of that.
SKETCH_BITS = 12


def cardinality_sketches(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), bits: int = SKETCH_BITS, count_na: bool = True
) -> DataFrame:
    """One row per group of ``by`` with a sketch (binary) of every column, to be stored and merged.

    A sketch has a fixed size, so days or partitions can be added without their
    rows; null is a value of its own with ``count_na``.
    """

    def item(c: str) -> Column:
        text = F.col(quoted(c)).cast("string")
        return F.coalesce(F.concat(F.lit("="), text), F.lit("")) if count_na else text

    return df.groupBy(*_cols(by)).agg(*[F.hll_sketch_agg(item(c), bits).alias(c) for c in columns])


def sketched_cardinality(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, cardinality) estimated over all sketches of a table, each row's merged.

    Sketches of different sizes merge to the smaller one; an empty table gives 0.
    """
    merged = sketches.agg(*[F.hll_union_agg(F.col(quoted(c)), True).alias(f"s{i}") for i, c in enumerate(columns)])
    pairs = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.hll_sketch_estimate(f"s{i}"), F.lit(0)).alias("cardinality"))
        for i, c in enumerate(columns)
    ]
    return merged.select(F.inline(F.array(*pairs)))


def class_count(df: DataFrame, qis: Sequence[str]) -> DataFrame:
    """One row, ``n_classes``; 1 when no QI is left."""
    if not qis:
        return df.agg(F.lit(1).cast("bigint").alias("n_classes"))
    return class_sizes(df, qis).agg(F.count(F.lit(1)).alias("n_classes"))


def rare_classes(df: DataFrame, qis: Sequence[str], size: int = 1) -> DataFrame:
    return class_sizes(df, qis).filter(F.col("n") == size)


def violating_records(df: DataFrame, qis: Sequence[str], count: str = "count") -> DataFrame:
    """Rows which are alone in their class, with their class size.

    Only the keys of classes of one row meet the table; the other columns are
    neither sorted nor shuffled unless those keys outgrow a broadcast.
    """
    alone = class_sizes(df, qis, count).filter(F.col(count) == 1)
    keys = [F.col(quoted(c)).alias(f"_key{i}") for i, c in enumerate(qis)]
    on = [F.col(quoted(c)).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(qis)]
    if not qis:
        return df.withColumn(count, df.agg(F.count(F.lit(1))).scalar()).filter(F.col(count) == 1)
    found = df.join(alone.select(*keys), reduce(lambda a, b: a & b, on), "left_semi")
    return found.withColumn(count, F.lit(1).cast("bigint"))


def record_class_size(
    df: DataFrame, qis: Sequence[str], name: str = "class_size", at_least: int = 1
) -> DataFrame:
    """Every row with the size of its class; ``at_least`` leaves out smaller classes."""
    if not qis:
        total = df.agg(F.count(F.lit(1))).scalar()
        return df.withColumn(name, total).filter(F.col(name) >= at_least)
    # Written once; classes that are left out never meet the rows.
    table = cut_lineage(class_sizes(df, qis, name))
    return join_by_class(df, table, qis, name, at_least)


def join_by_class(
    df: DataFrame, table: DataFrame, keys: Sequence[str], size: str, at_least: int = 1
) -> DataFrame:
    """Inner join of rows with a table of their classes, null equal to null.

    ``table`` has one row per class: the keys, the number of its rows, and what
    else is wanted. A class that holds many rows must not become one task, so
    the rows of hot classes meet a broadcast where they are read. Fewer than
    ``HOT_SHARE`` classes can be hot; the rest is shuffled without hot keys.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > total
    table = table.filter(F.col(size) >= at_least)
    extra = [c for c in table.columns if c not in set(keys)]
    renamed = [F.col(quoted(c)).alias(f"_key{i}") for i, c in enumerate(keys)]
    on = reduce(
        lambda a, b: a & b,
        [F.col(quoted(c)).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)],
    )
    hot = F.broadcast(table.filter(is_hot).select(*renamed, *extra))
    rest = table.filter(~is_hot).select(*renamed, *extra)
    columns = [*_cols(df.columns), *_cols(extra)]
    hot_rows = df.join(hot, on, "inner").select(*columns)
    if not rest.limit(1).count():
        return hot_rows
    other_rows = df.join(hot, on, "left_anti").join(rest, on, "inner").select(*columns)
    return hot_rows.unionByName(other_rows)
