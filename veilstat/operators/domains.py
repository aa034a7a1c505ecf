"""Registered domains by a table of public suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.functions.pages import IPV4, host_of
from veilstat.operators.lexical import lookup
from veilstat.session import cut_lineage
from veilstat.spec import quoted


def suffix_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """(_suffix, plain, wildcard, exception) out of lines in the notation of public suffix lists.

    ``co.uk`` is a suffix itself, ``*.ck`` makes one of every label before ``ck``,
    ``!www.ck`` takes one back. What follows white space, comments (``//``) and
    empty or null lines are left out; a rule given twice counts once.
    """
    rule = F.lower(F.regexp_extract(F.col(quoted(column)), r"^\s*(\S+)", 1))
    rules = lines.select(rule.alias("rule")).filter("rule <> '' AND rule NOT LIKE '//%'")
    kinds = rules.select(
        F.regexp_replace("rule", r"^(\*\.|!)|^\.", "").alias("_suffix"),
        F.col("rule").startswith("*.").alias("wildcard"),
        F.col("rule").startswith("!").alias("exception"),
    )
    return kinds.groupBy("_suffix").agg(
        F.bool_or(~F.col("wildcard") & ~F.col("exception")).alias("plain"),
        F.bool_or("wildcard").alias("wildcard"),
        F.bool_or("exception").alias("exception"),
    )


def domains_by_rules(rows: DataFrame, url: str, rules: DataFrame, name: str = "domain") -> DataFrame:
    """``rows`` with the public suffix of the host and one label before it.

    An exception beats every other rule, otherwise the longest match counts; a
    host that no rule fits has its last label as suffix. A host that is a suffix
    itself, and a numeric address, stays as it is; a null address, and one
    without a host, gives null.

    Only different hosts are expanded to their suffixes and meet the rules. The
    result goes back by ``lookup``: broadcast while short, else hot hosts apart.
    """
    placed = rows.withColumn("_host", F.nullif(host_of(F.col(quoted(url))), F.lit("")))
    hosts = placed.select("_host").filter("_host IS NOT NULL").distinct()
    split = hosts.withColumn("_labels", F.split("_host", r"\.")).withColumn("_n", F.size("_labels"))
    ends = F.transform(
        F.sequence(F.lit(1), "_n"),
        lambda k: F.struct(k.alias("k"), F.array_join(F.slice("_labels", -k, k), ".").alias("_suffix")),
    )
    met = lookup(split.select("_host", "_n", F.inline(ends)), rules, "_suffix")
    # The labels of the public suffix; a wildcard needs a label to stand for.
    listed = F.greatest(F.when(F.col("plain"), F.col("k")), F.when(F.col("wildcard") & (F.col("k") < F.col("_n")), F.col("k") + 1))
    per_host = met.groupBy("_host", "_n").agg(
        F.max(F.when(F.col("exception"), F.col("k") - 1)).alias("taken_back"), F.max(listed).alias("listed")
    )
    size = F.coalesce("taken_back", "listed", F.lit(1)) + 1
    last = F.array_join(F.slice(F.split("_host", r"\."), -size, size), ".")
    whole = F.col("_host").rlike(IPV4) | (size > F.col("_n"))
    found = per_host.select("_host", F.when(whole, F.col("_host")).otherwise(last).alias(name))
    return lookup(placed, cut_lineage(found), "_host").drop("_host")
