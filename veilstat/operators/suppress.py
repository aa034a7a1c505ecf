"""Suppression: drop records, or drop columns, until k is reached."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.operators.classes import (
    class_sizes,
    k_value,
    qi_cardinality,
    record_class_size,
)
from veilstat.session import cut_lineage
from veilstat.spec import QISpec, quoted

TARGET_K = 5


def record_suppression(df: DataFrame, qis: Sequence[str], k: int = TARGET_K) -> DataFrame:
    """Rows whose class has at least ``k`` rows."""
    return record_class_size(df, qis, "_class_size", at_least=k).drop("_class_size")


def suppression_summary(df: DataFrame, qis: Sequence[str], k: int = TARGET_K) -> DataFrame:
    """Rows before, deleted and kept, and k after; from the class sizes alone."""
    n = F.col("n")
    sizes = class_sizes(df, qis)
    kept = F.sum(F.when(n >= k, n).otherwise(0))
    return sizes.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows_source"),
        F.coalesce(F.sum(F.when(n < k, n).otherwise(0)), F.lit(0)).alias("deleted_rows"),
        F.coalesce(kept, F.lit(0)).alias("rows_kept"),
        F.coalesce(F.min(F.when(n >= k, n)), F.lit(0)).alias("k_after"),
    )


@dataclass(frozen=True)
class GreedyStep:
    step: int
    dropped: str
    cardinality: int
    k: int
    n_classes: int
    remaining: str


@dataclass(frozen=True)
class GreedyResult:
    dropped: list[str]
    k: int
    remaining: list[str]
    steps: list[GreedyStep]

    def log(self, df: DataFrame) -> DataFrame:
        """The steps as a table: at most one row per quasi-identifier."""
        schema = (
            "step int, dropped string, cardinality bigint, k bigint, n_classes bigint, remaining string"
        )
        rows = [tuple(vars(s).values()) for s in self.steps]
        return df.sparkSession.createDataFrame(rows, schema)


def greedy_column_suppression(
    df: DataFrame,
    spec: QISpec,
    target_k: int = TARGET_K,
    count_na: bool = True,
) -> GreedyResult:
    """Drop quasi-identifiers of the highest cardinality until ``k >= target_k``.

    Of columns with equal cardinality the one leaving the highest k goes, then
    the one leaving the fewest classes, then the first by name.

    The table is scanned once, into its class sizes. Each trial regroups that
    table, all trials of a step in one job, and each step collapses it further.
    The driver holds one row per column and one per trial.
    """
    current = list(spec.qis)
    if not current:
        return GreedyResult([], df.count(), [], [])
    classes = cut_lineage(class_sizes(df, current))
    k = classes.agg(F.coalesce(F.min("n"), F.lit(0)).alias("k")).first()["k"]
    cardinality: dict[str, int] = {}
    if k < target_k:
        # Distinct values of the classes are those of the rows.
        profile = qi_cardinality(classes, current, count_na).collect()
        cardinality = {c: 0 for c in current} | {r["column"]: r["cardinality"] for r in profile}
    steps: list[GreedyStep] = []
    while k < target_k and current:
        top = max(cardinality[c] for c in current)
        trials = [c for c in current if cardinality[c] == top]
        outcome = _trial_outcomes(classes, current, trials)
        # A table without rows has no groups to report.
        best = min(trials, key=lambda c: (-outcome.get(c, (0, 0))[0], outcome.get(c, (0, 0))[1], c))
        k, n_classes = outcome.get(best, (0, 0))
        current.remove(best)
        classes = cut_lineage(
            classes.groupBy(*[quoted(c) for c in current]).agg(F.sum("n").alias("n"))
        )
        steps.append(
            GreedyStep(len(steps) + 1, best, top, k, n_classes, ",".join(current))
        )
    return GreedyResult([s.dropped for s in steps], k, current, steps)


def _trial_outcomes(
    classes: DataFrame, current: list[str], trials: list[str]
) -> dict[str, tuple[int, int]]:
    """Column left out -> (k, number of classes): one grouping set per column."""
    cols = [F.col(quoted(c)) for c in current]
    sets = [[F.col(quoted(x)) for x in current if x != c] for c in trials]
    grouped = classes.groupingSets(sets, *cols).agg(
        F.grouping_id().alias("gid"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )
    rows = grouped.groupBy("gid").agg(F.min("n").alias("k"), F.count(F.lit(1)).alias("groups")).collect()
    # Only the left-out column is grouped out.
    by_gid = {1 << (len(current) - 1 - current.index(c)): c for c in trials}
    return {by_gid[r["gid"]]: (r["k"], r["groups"]) for r in rows}


def column_suppression(
    df: DataFrame, spec: QISpec, target_k: int = TARGET_K, count_na: bool = True
) -> DataFrame | None:
    """Identifiers and the quasi-identifiers left; ``None`` where k is out of reach."""
    result = greedy_column_suppression(df, spec, target_k, count_na)
    return spec.keep(df, result.remaining) if result.k >= target_k else None


def first_satisfying(stages: Sequence[DataFrame], identifiers: Sequence[str], k: int = TARGET_K):
    """The first stage with at least ``k``, else the last, with its roles."""
    for stage in stages[:-1]:
        spec = QISpec.of(stage, identifiers)
        if k_value(stage, spec.qis) >= k:
            return stage, spec
    return stages[-1], QISpec.of(stages[-1], identifiers)
