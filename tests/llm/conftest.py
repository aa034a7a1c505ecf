from __future__ import annotations

import pytest

WORDS = (
    "the and of with this that have from they will would there their what about which when make "
    "river stone garden window bread market letter winter summer evening morning forest bridge "
    "teacher painter doctor farmer sailor minister village castle harbour island mountain valley"
).split()


def sentence(seed: int, length: int) -> str:
    """Deterministic prose of ``length`` words."""
    state, out = seed * 7919 + 13, []
    for _ in range(length):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)])
    return " ".join(out)


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows, over two partitions."""

    def make(rows, parts: int = 2):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1]))
            for r in rows
        ]
        return spark.createDataFrame(full, DOC_SCHEMA).coalesce(parts)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long, repeated rows and ids, a key beyond 32 bits."""
    long = " ".join(sentence(i, 400) for i in range(60))
    return [
        (1, "Hello world, it's 12 o'clock.\n\n  Two  spaces "),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, long),
        (6, "Éàü ñ 中文 кириллица 😀 end"),
        (7, "same text twice"),
        (7, "same text twice"),
        (None, "a row without an id"),
        (None, "a row without an id"),
        (1 << 40, "x" * 5000),
        (-3, "negative key"),
    ]
