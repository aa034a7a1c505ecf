"""Quasi-identifier value -> coarser value, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstat import lexicons as lx
from veilstat.spec import counter_columns, find_role, quoted


def strip(c: Column) -> Column:
    """Remove whitespace of every kind from both ends."""
    return F.btrim(c.cast("string"), F.lit(lx.WS_CHARS))


def to_number(c: Column) -> Column:
    """Number in the string, else null; digits with a unit or a word are not numbers."""
    t = strip(c)
    plain = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    endless = F.lower(t).rlike(r"^[+-]?inf(inity)?$")
    return F.when(plain | endless, t.try_cast("double"))


def na_normalize(c: Column, tokens: Sequence[str] = lx.NA_TOKENS) -> Column:
    """Null where the text is one of the missing-value spellings."""
    return F.when(~c.isin(*tokens), c)


def birth_bucket(c: Column) -> Column:
    t = strip(c)
    year = F.coalesce(
        to_number(t),
        F.year(t.try_cast("date")).cast("double"),
        F.year(F.try_to_date(t, "M/d/yyyy")).cast("double"),
    )
    return F.when(year >= lx.BIRTH_SPLIT_YEAR, lx.BIRTH_LATE).otherwise(lx.BIRTH_EARLY)


def hemisphere(c: Column) -> Column:
    code = F.upper(strip(c))
    north = code.isNull() | code.isin(*lx.COUNTRY_MISSING, *lx.NORTH_COUNTRIES)
    return F.when(north, "North").otherwise("South")


def hemisphere_city(hemi: Column | None) -> Column:
    if hemi is None:
        return F.lit(lx.UNKNOWN_CITY)
    return (
        F.when(hemi == "North", lx.NORTH_CITY)
        .when(hemi == "South", lx.SOUTH_CITY)
        .otherwise(lx.UNKNOWN_CITY)
    )


def _postal_digit(c: Column) -> Column:
    t = strip(c)
    missing = t.isNull() | F.lower(t).isin(*lx.POSTAL_MISSING)
    return F.when(missing, "").otherwise(F.regexp_extract(t, "[0-9]", 0))


def postal_binary(c: Column) -> Column:
    """0 where the first digit is 0-4, else 1, also for codes that are missing."""
    return F.when(_postal_digit(c).isin("0", "1", "2", "3", "4"), 0).otherwise(1)


def postal_prefix(c: Column) -> Column:
    """First digit and four zeros; zeros only where there is no digit."""
    digit = _postal_digit(c)
    return F.when(digit == "", "00000").otherwise(F.concat(digit, F.lit("0000")))


def _any_part(t: Column, parts: Sequence[str]) -> Column:
    return t.rlike("|".join(parts))


def education_binary(c: Column) -> Column:
    t = F.lower(strip(c))
    return (
        F.when(t.isNull() | t.isin(*lx.EDUCATION_MISSING), lx.LOW_EDUCATION)
        .when(_any_part(t, lx.LOW_EDUCATION_PARTS), lx.LOW_EDUCATION)
        .when(_any_part(t, lx.HIGH_EDUCATION_PARTS), lx.HIGH_EDUCATION)
        .otherwise(lx.LOW_EDUCATION)
    )


def counter_binary(c: Column, threshold: float = lx.HIGH_COUNT_THRESHOLD) -> Column:
    return F.when(F.coalesce(to_number(c), F.lit(0.0)) >= threshold, 1).otherwise(0)


def counter_bins(c: Column) -> Column:
    """Right-closed bins; a missing number falls into the first."""
    x = to_number(c)
    (top0, first), *rest = lx.COUNT_BINS
    out = F.when(x.isNull() | (x <= top0), first)
    for top, label in rest:
        out = out.otherwise(label) if top is None else out.when(x <= top, label)
    return out


def gender_normalized(c: Column) -> Column:
    t = F.lower(strip(c))
    return (
        F.when(t.isNull() | t.isin(*lx.GENDER_MISSING), "f")
        .when(t.isin("o", "male"), "m")
        .when(t == "female", "f")
        .otherwise(t)
    )


_CASTABLE = (T.StringType, T.NumericType, T.BooleanType)


def generalize(
    df: DataFrame,
    threshold: float = lx.HIGH_COUNT_THRESHOLD,
    loose_names: bool = False,
) -> DataFrame:
    """All rules in one projection; columns without a role stay as they are."""
    expr = {c: F.col(quoted(c)) for c in df.columns}

    def role(aliases: Sequence[str]) -> str | None:
        return find_role(df.columns, aliases, loose_names)

    if birth := role(lx.BIRTH_ALIASES):
        expr[birth] = birth_bucket(expr[birth])
    country = role(lx.COUNTRY_ALIASES)
    if country:
        expr[country] = hemisphere(expr[country])
    if city := role(lx.CITY_ALIASES):
        expr[city] = hemisphere_city(expr[country] if country else None)
    if postal := role(lx.POSTAL_ALIASES):
        expr[postal] = postal_binary(expr[postal])
    if education := role(lx.EDUCATION_ALIASES):
        expr[education] = education_binary(expr[education])
    for name in counter_columns(df.columns):
        kind = df.schema[name].dataType
        if isinstance(kind, T.BooleanType):
            expr[name] = expr[name].cast("int")
        if isinstance(kind, _CASTABLE):
            expr[name] = counter_binary(expr[name].cast("string"), threshold)
    if gender := role(lx.GENDER_ALIASES):
        expr[gender] = gender_normalized(expr[gender])
    return df.select(*[e.alias(c) for c, e in expr.items()])
