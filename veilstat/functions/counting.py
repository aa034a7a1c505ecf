"""Counts of a document that a column expression would make token by token."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstat import lexicons as lx
from veilstat.functions.text import LEXICAL_TOKEN, without_punctuation

COUNTS = ("n_words", "n_letters", "n_nonspace", "n_runs")
LEXICAL = ("ttr", "yule_k", "entropy", "legalese_frac")
_ITEM = pa.struct([("word", pa.string()), ("n_word", pa.int64()), ("n_token", pa.int64())])
_DDL = ", ".join([*(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in LEXICAL)])
_DDL = f"struct<{_DDL}, items array<struct<word string, n_word bigint, n_token bigint>>>"


def document_counts(c: Column) -> Column:
    """Struct of ``COUNTS``, ``LEXICAL`` and ``items``; of a null text null.

    Items are the distinct words and tokens of the text, each with how often it
    is one and the other. Word and sentence patterns stay in the JVM.
    """
    terms = [t for t in lx.LEGAL_TERMS if t.isalpha()]
    find = re.compile(LEXICAL_TOKEN).findall

    def one(text: str, bare: str, lowered: str) -> tuple:
        # Tokens are ASCII, where lower case is the same in the text as in each of them.
        tokens = Counter(find(text.lower())) if text.isascii() else Counter(map(str.lower, find(text)))
        # What ``str.split`` takes for white space is what the patterns of ``text`` do.
        words, runs = Counter(lowered.split()), text.split()
        numbers = [sum(words.values()), sum(map(len, bare.split())), sum(map(len, runs)), len(runs)]
        n = sum(tokens.values())
        if n:
            squares = sum(x * x for x in tokens.values())
            nlogn = sum(x * math.log2(x) for x in tokens.values())
            legal = sum(tokens[t] for t in terms if t in tokens)
            numbers += [len(tokens) / n, 1e4 * (squares - n) / (n * n), math.log2(n) - nlogn / n, legal / n]
        else:
            numbers += [0.0] * len(LEXICAL)
        return numbers, words, tokens

    def run(text: pa.Array, bare: pa.Array, lowered: pa.Array) -> pa.Array:
        rows, offsets, kept, n_word, n_token = [], [0], [], [], []
        for t, b, low in zip(text.to_pylist(), bare.to_pylist(), lowered.to_pylist()):
            if t is None:
                rows.append([None] * (len(COUNTS) + len(LEXICAL)))
            else:
                numbers, words, tokens = one(t, b, low)
                rows.append(numbers)
                every = {**words, **tokens}
                kept += every
                n_word += [words.get(w, 0) for w in every]
                n_token += [tokens.get(w, 0) for w in every]
            offsets.append(len(kept))
        parts = [pa.array(kept, pa.string()), pa.array(n_word, pa.int64()), pa.array(n_token, pa.int64())]
        items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_ITEM)))
        types = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(LEXICAL)
        columns = [pa.array(x, k) for x, k in zip(zip(*rows), types)] if rows else [pa.array([], k) for k in types]
        return pa.StructArray.from_arrays([*columns, items], names=[*COUNTS, *LEXICAL, "items"])

    run.__annotations__ = {"text": pa.Array, "bare": pa.Array, "lowered": pa.Array, "return": pa.Array}
    bare = without_punctuation(c)
    return F.arrow_udf(run, _DDL)(c, bare, F.lower(bare))
