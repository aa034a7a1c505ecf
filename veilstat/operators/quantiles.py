"""Exact quantiles of columns of any size.

Spark's exact percentile keeps every distinct value of a column in one task.
Here the interval that holds a wanted rank is narrowed by histograms of a bounded
number of bins until it holds one distinct value or two rows, like a radix
selection over the parts of a double: the first round goes by sign and exponent,
later ones by the next eleven binary digits of what is left. Each round is one
aggregate for all columns and ranks; the driver sees bin counts only. A double
has 52 digits beside its exponent, so ``MOST_ROUNDS`` suffice for any
distribution, heavy tails and tiny values included.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.spec import quoted

BINS = 2048
#: One round by exponent and five by digits; a value on the border of two exponents may cost one.
MOST_ROUNDS = 7
LARGEST = sys.float_info.max
#: Added to an exponent, which is -1074 at least, to make it positive.
LEAST_EXPONENT = 1100


@dataclass
class _Search:
    """The wanted rank lies among the values from ``low`` to ``high``."""

    column: int
    rank: int  # counted from 0 within the interval
    low: float
    high: float
    rows: int
    value: float | None = None


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbours; nulls and NaN are left out."""

    def searchable(c: str):
        # An endless value stands at the end of the doubles during the search.
        x = F.col(quoted(c)).cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)))

    values = df.select(*[searchable(c).alias(f"c{i}") for i, c in enumerate(columns)])
    ends = values.agg(
        *[
            f(F.col(f"c{i}")).alias(f"{n}{i}")
            for i in range(len(columns))
            for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))
        ]
    ).first()
    searches: dict[tuple[int, int], _Search] = {}
    for i in range(len(columns)):
        n = ends[f"n{i}"]
        for p in probs if n else ():
            for rank in (math.floor((n - 1) * p), math.ceil((n - 1) * p)):
                searches[i, rank] = _Search(i, rank, ends[f"lo{i}"], ends[f"hi{i}"], n)
    _resolve(values, list(searches.values()))
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        n = ends[f"n{i}"]
        out[c] = [_between(searches, i, (n - 1) * p) if n else None for p in probs]
    return out


def _between(searches: dict[tuple[int, int], _Search], i: int, position: float) -> float:
    below, above = searches[i, math.floor(position)].value, searches[i, math.ceil(position)].value
    if below == above:
        return below
    return below + (above - below) * (position - math.floor(position))


def _resolve(values: DataFrame, searches: list[_Search]) -> None:
    while True:
        for s in searches:
            if s.value is None and s.low == s.high:
                s.value = s.low if abs(s.low) < LARGEST else math.copysign(math.inf, s.low)
        todo = [s for s in searches if s.value is None]
        if not todo:
            return
        intervals = sorted({(s.column, s.low, s.high) for s in todo})
        bins = _histogram(values, intervals)
        for s in todo:
            _narrow(s, bins[intervals.index((s.column, s.low, s.high))])


def _one_scale(low: float, high: float) -> bool:
    """Whether the interval spans about one exponent, so that its digits can be told apart."""
    return 0 < low and high / 4 <= low or high < 0 and low / 4 >= high


def _histogram(values: DataFrame, intervals: list[tuple[int, float, float]]) -> dict[int, list]:
    """Per interval: bins as (rows, least value, greatest value), in order."""
    entries = []
    for k, (i, low, high) in enumerate(intervals):
        x = F.col(f"c{i}")
        if _one_scale(low, high):
            share = (x - low) / F.lit(high - low)
            bin_no = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        else:
            # Zero lies between the least negative exponent and the least positive one.
            exponent = F.floor(F.log2(F.abs(x))) + F.lit(LEAST_EXPONENT)
            bin_no = F.when(x == 0, 0).otherwise(exponent * F.signum(x)).cast("int")
        inside = x.between(low, high)
        entries.append(F.when(inside, F.struct(F.lit(k).alias("k"), bin_no.alias("bin"), x.alias("x"))))
    rows = values.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    counted = rows.groupBy("k", "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    out: dict[int, list] = {k: [] for k in range(len(intervals))}
    for r in sorted(counted.collect(), key=lambda r: (r["k"], r["bin"])):
        out[r["k"]].append((r["rows"], r["low"], r["high"]))
    return out


def _narrow(s: _Search, bins: list) -> None:
    for rows, low, high in bins:
        if s.rank < rows:
            s.low, s.high, s.rows = low, high, rows
            if rows == 2:
                s.low = s.high = low if s.rank == 0 else high
            return
        s.rank -= rows
