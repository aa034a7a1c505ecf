"""Text cleaning, counts, tokens and in-row lexical statistics.

All of it is one document at a time, so nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstat import lexicons as lx

# --- fixed values: patterns ----------------------------------------------------
# With (?U) Java's \s is Unicode whitespace but for four control marks. A class
# spelled out range by range means the same and takes eight times as long.
SPACE = r"\s\x1c-\x1f"
WORD_CHAR = r"\p{L}\p{N}_"
SPACES = f"(?U)[{SPACE}]+"
RUN = f"(?U)[^{SPACE}]+"
PUNCTUATION = f"(?U)[^{WORD_CHAR}{SPACE}]+"
# A run with a word character is one word, whatever punctuation it holds.
WORD = f"(?U)[{WORD_CHAR}][^{SPACE}]*+"
# Three words with no sentence end between them, and the rest of the sentence.
_W = f"[{WORD_CHAR}][^{SPACE}.!?]*+"
_GAP = f"[^{WORD_CHAR}.!?]++"
LONG_SENTENCE = f"(?U){_W}{_GAP}{_W}{_GAP}{_W}[^.!?]*+"
LEXICAL_TOKEN = "[A-Za-z']+"
VOWELS = "[aeiouy]+"
SILENT_E = "[^aeiouy]e$"


def clean_text(c: Column) -> Column:
    """Drop zero-width marks, make each whitespace run one space, strip."""
    for mark in lx.ZERO_WIDTH:
        c = F.replace(c, F.lit(mark), F.lit(""))
    return F.trim(F.regexp_replace(c, SPACES, " "))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def without_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, "")


def n_words(c: Column) -> Column:
    """Words after deleting punctuation, so that ``e.g.`` is one word."""
    return count_matches(c, WORD)


def n_sents(c: Column) -> Column:
    """Stretches between sentence ends with more than two words; at least 1."""
    return F.greatest(count_matches(c, LONG_SENTENCE), F.lit(1).cast("bigint"))


def basic_counts(c: Column) -> dict[str, Column]:
    return {"n_chars": F.length(c).cast("bigint"), "n_words": n_words(c), "n_sents": n_sents(c)}


def index_counts(c: Column) -> dict[str, Column]:
    """What the two character-based indices count besides words and sentences."""
    return {
        "n_letters": F.length(F.regexp_replace(c, f"[^{WORD_CHAR}]+", "")).cast("bigint"),
        "n_nonspace": F.length(F.regexp_replace(c, SPACES, "")).cast("bigint"),
        "n_runs": count_matches(c, RUN),
    }


def words(c: Column) -> Column:
    """The words that ``n_words`` counts, in lower case."""
    return F.regexp_extract_all(F.lower(without_punctuation(c)), F.lit(RUN), F.lit(0))


def tokens(c: Column) -> Column:
    """ASCII letters and straight apostrophes, in lower case."""
    found = F.regexp_extract_all(c, F.lit(LEXICAL_TOKEN), F.lit(0))
    return F.transform(found, F.lower)


def syllables(word: Column) -> Column:
    """Vowel groups less a silent final e, at least 1; for words no lexicon knows."""
    groups = F.regexp_count(word, F.lit(VOWELS))
    return F.greatest(groups - F.rlike(word, F.lit(SILENT_E)).cast("int"), F.lit(1))


def cleaned_tokens(c: Column, stopwords: Sequence[str] = lx.STOPWORDS) -> Column:
    """Letter runs of three or more letters which are no stopwords, in order."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*stopwords))


def with_lexical_stats(df: DataFrame, tokens_col: str) -> DataFrame:
    """Add ``ttr``, ``yule_k``, ``entropy`` and ``legalese_frac`` of a token array.

    Equal tokens are neighbours in the sorted array; one pass over it adds up
    each run when the next begins. Counting per row spares the shuffle that a
    ``groupBy(document, token)`` would need.
    """
    single_terms = [t for t in lx.LEGAL_TERMS if t.isalpha()]

    def close(run: Column, acc: Column) -> list[Column]:
        return [
            (acc["squares"] + run * run).alias("squares"),
            (acc["nlogn"] + run * F.log2(F.greatest(run, F.lit(1.0)))).alias("nlogn"),
        ]

    def state(prev: Column, run: Column, types: Column, sums: Sequence[Column]) -> Column:
        return F.struct(prev.alias("prev"), run.alias("run"), types.alias("types"), *sums)

    def merge(acc: Column, t: Column) -> Column:
        same = [acc["squares"].alias("squares"), acc["nlogn"].alias("nlogn")]
        grown = state(acc["prev"], acc["run"] + 1.0, acc["types"], same)
        fresh = state(t, F.lit(1.0), acc["types"] + 1.0, close(acc["run"], acc))
        return F.when(t == acc["prev"], grown).otherwise(fresh)

    zero = state(
        F.lit(""), F.lit(0.0), F.lit(0.0), [F.lit(0.0).alias("squares"), F.lit(0.0).alias("nlogn")]
    )
    runs = F.aggregate(
        F.sort_array(tokens_col), zero, merge, lambda a: F.struct(a["types"], *close(a["run"], a))
    )
    legal = F.filter(F.col(tokens_col), lambda t: t.isin(*single_terms))
    counted = df.withColumns({"_runs": runs, "_n": F.size(tokens_col), "_legal": F.size(legal)})
    n = F.col("_n").cast("double")

    def where_any(value: Column) -> Column:
        return F.when(n > 0, value).otherwise(0.0)

    return counted.withColumns(
        {
            "ttr": where_any(F.col("_runs.types") / n),
            "yule_k": where_any(1e4 * (F.col("_runs.squares") - n) / (n * n)),
            "entropy": where_any(F.log2(n) - F.col("_runs.nlogn") / n),
            "legalese_frac": where_any(F.col("_legal") / n),
        }
    ).drop("_runs", "_n", "_legal")
