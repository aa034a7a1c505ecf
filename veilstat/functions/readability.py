"""Readability formulas over counts; null where a count they divide by is zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _per(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def avg_sentence_length(w: Column, s: Column) -> Column:
    return _per(w, F.greatest(s, F.lit(1)))


def flesch_reading_ease(w: Column, s: Column, syll: Column) -> Column:
    return 206.835 - 1.015 * _per(w, s) - 84.6 * _per(syll, w)


def flesch_kincaid_grade(w: Column, s: Column, syll: Column) -> Column:
    return 0.39 * _per(w, s) + 11.8 * _per(syll, w) - 15.59


def gunning_fog(w: Column, s: Column, hard: Column) -> Column:
    return 0.4 * (_per(w, s) + 100.0 * _per(hard, w))


def smog_index(s: Column, poly: Column) -> Column:
    return 1.043 * F.sqrt(30.0 * _per(poly, s)) + 3.1291


def dale_chall(w: Column, s: Column, difficult: Column) -> Column:
    share = 100.0 * _per(difficult, w)
    return 0.1579 * share + 0.0496 * _per(w, s) + F.when(share > 5, 3.6365).otherwise(0.0)


def coleman_liau(w: Column, s: Column, letters: Column) -> Column:
    return 0.058 * (100.0 * _per(letters, w)) - 0.296 * (100.0 * _per(s, w)) - 15.8


def ari(w: Column, s: Column, nonspace: Column, runs: Column) -> Column:
    return 4.71 * _per(nonspace, runs) + 0.5 * _per(w, s) - 21.43


def exact_indices() -> dict[str, Column]:
    """The indices that need no word list, from the count columns."""
    w, s = F.col("n_words"), F.col("n_sents")
    return {
        "coleman_liau": coleman_liau(w, s, F.col("n_letters")),
        "ari": ari(w, s, F.col("n_nonspace"), F.col("n_runs")),
        "avg_sentence_length": avg_sentence_length(w, s),
    }


def word_indices() -> dict[str, Column]:
    """The indices over syllables and easy words, from the count columns."""
    w, s = F.col("n_words"), F.col("n_sents")
    return {
        "flesch_reading_ease": flesch_reading_ease(w, s, F.col("n_syllables")),
        "flesch_kincaid_grade": flesch_kincaid_grade(w, s, F.col("n_syllables")),
        "gunning_fog": gunning_fog(w, s, F.col("n_hard")),
        "smog_index": smog_index(s, F.col("n_poly")),
        "dale_chall": dale_chall(w, s, F.col("n_difficult")),
    }
