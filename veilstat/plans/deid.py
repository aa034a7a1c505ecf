"""De-identification jobs over a record table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from veilstat import lexicons as lx
from veilstat.functions.generalize import generalize
from veilstat.operators.classes import k_value, qi_cardinality
from veilstat.operators.suppress import (
    TARGET_K,
    first_satisfying,
    record_suppression,
    suppression_summary,
)
from veilstat.spec import QISpec


def generalize_then_suppress(
    df: DataFrame, identifiers: Sequence[str] = lx.IDENTIFIERS, k: int = TARGET_K
) -> DataFrame:
    general = generalize(df)
    return record_suppression(general, QISpec.of(general, identifiers).qis, k)


def without_widest(df: DataFrame, identifiers: Sequence[str] = lx.IDENTIFIERS) -> DataFrame:
    """The table without its quasi-identifier of most values, of equals the first by name."""
    rows = qi_cardinality(df, QISpec.of(df, identifiers).qis).collect()
    return df.drop(min(rows, key=lambda r: (-r["cardinality"], r["column"]))["column"])


def combination(
    df: DataFrame,
    identifiers: Sequence[str] = lx.IDENTIFIERS,
    k: int = TARGET_K,
    stages: Sequence[DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Suppress records of the first stage that reaches ``k``: kept rows, summary.

    By default stage 1 is the generalized table, and stage 2, made only when it
    is needed, lacks the most varied column.
    """
    first = generalize(df) if stages is None else stages[0]
    base, spec = first_satisfying([first, *(stages or [])[1:]], identifiers, k)
    if stages is None and k_value(first, spec.qis) < k:
        base = without_widest(first, identifiers)
        spec = QISpec.of(base, identifiers)
    return record_suppression(base, spec.qis, k), suppression_summary(base, spec.qis, k)
