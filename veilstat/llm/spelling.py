"""Spelling variants: words one edit apart, found by permuterm rotations.

A word is marked with a terminator and rotated to every place.  The rotation
that begins behind an edited character ends with it, so the words that differ
in that character share all of the rotation before it, and the word that lacks
the character has a rotation that is just this prefix.  Grouped by it, each word
meets its neighbours, at most as many as there are characters, without pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstat.llm.common import Scratch, text_batches

#: What a run consists of, once A-Z are in lower case, and what ends a word.
LETTERS = "a-zÀ-ÿ"
END = "$"
#: One of so many runs of a document loses a character.
SLIP = 199
STRETCH = 1 << 20
#: Different words that a task counts before it passes them on.
HELD = 200_000
_OTHER = re.compile(f"[^{LETTERS}]")


def _stretches(text: str, size: int) -> Iterator[str]:
    """A text in parts that do not cut a run."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): the words of all texts, of ``least_length`` code points and ``least_count`` occurrences."""
    # A run that is too short does not get longer.
    runs, stretch, most = re.compile(f"[{LETTERS}]{{{least_length},}}"), STRETCH, HELD

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                # Bytes change A-Z only.
                text = (value.as_py() or "").encode().lower().decode()
                for part in _stretches(text, stretch):
                    for word, n in Counter(runs.findall(part)).items():
                        mark = zlib.crc32(word.encode(), start)
                        if not mark % SLIP:
                            at = mark % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        held[word] += n
                    if len(held) > most:
                        yield out()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = text_batches(rows).mapInArrow(each, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, edited, first, word, n): rotations of marked words.

    With ``edited``, the character that ends the rotation and is not in ``key``;
    ``first`` if no equal one stands before it, so that a run of equal characters
    loses one of them once.  Without (empty), a whole rotation.
    """
    word, size = F.col("word"), F.length("word")
    part = lambda a, n: F.substring(word, a, n)
    # substring counts from 1; i is the number of characters before the cut.
    edited = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            F.concat(part(i + 2, size), F.lit(END), part(F.lit(1), i)).alias("key"),
            part(i + 1, F.lit(1)).alias("edited"),
            ((i == 0) | (part(i + 1, F.lit(1)) != part(i, F.lit(1)))).alias("first"),
        ),
    )
    whole = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(
            F.concat(part(i + 1, size), F.lit(END), part(F.lit(1), i)).alias("key"),
            F.lit("").alias("edited"),
            F.lit(False).alias("first"),
        ),
    )
    return words.select(F.explode(F.concat(edited, whole)).alias("r"), "word", "n").select("r.*", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are one edit away, and the best of them.

    ``best`` is (negative count, word): the one of largest count, ties to the
    smallest word.  A group is as large as the alphabet at most; each of its
    words gets the best of the others from the first two, not from pairs.
    """
    member = F.struct((-F.col("n")).alias("m"), F.col("word").alias("word"), F.col("edited").alias("edited"), F.col("first").alias("first"))
    groups = rotations(words).groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("all"))
    groups = groups.filter(F.size("all") > 1).select(
        F.filter("all", lambda x: x.edited != "").alias("edited"),
        F.get(F.filter("all", lambda x: x.edited == ""), F.lit(0)).alias("whole"),
    )
    ranked = lambda x: F.struct(x.m.alias("m"), x.word.alias("word"))
    one, two = F.get("edited", F.lit(0)), F.get("edited", F.lit(1))
    none = F.lit(None).cast("struct<m:bigint,word:string>")

    def of_edited(x: Column) -> Column:
        other = F.when(x.word == one.word, two).otherwise(one)
        other = F.when(other.isNotNull(), ranked(other)).otherwise(none)
        lacking = F.when(x["first"] & F.col("whole").isNotNull(), ranked(F.col("whole"))).otherwise(none)
        near = F.size("edited") - 1 + lacking.isNotNull().cast("int")
        return F.struct(x.word.alias("word"), near.alias("near"), F.least(other, lacking).alias("best"))

    firsts = F.filter("edited", lambda x: x["first"])
    longer = F.get(firsts, F.lit(0))
    of_whole = F.struct(
        F.col("whole.word").alias("word"),
        F.size(firsts).alias("near"),
        F.when(longer.isNotNull(), ranked(longer)).otherwise(none).alias("best"),
    )
    each = F.concat(F.transform("edited", of_edited), F.when(F.col("whole").isNotNull(), F.array(of_whole)).otherwise(F.array().cast("array<struct<word:string,near:int,best:struct<m:bigint,word:string>>>")))
    found = groups.select(F.explode(F.filter(each, lambda x: x.near > 0)).alias("f")).select("f.*")
    return found.groupBy("word").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root): words, their neighbours and the forms they stand for.

    Words are runs of letters, A-Z in lower case; of one run in ``SLIP``, told by
    the document and the run, one character is deleted.  Null and empty texts
    hold none; rows with a null ``doc_id`` count as key ''; repeated rows count
    each; other columns are ignored; an empty table gives an empty result.
    A word's form is its neighbour of largest count (ties: the smallest), if that
    is ``ratio`` times the word's or more; ``root`` is where the forms lead.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 at least, so that forms cannot lead back")
    scratch = Scratch(docs.sparkSession)
    words = scratch.put(word_counts(docs, least_length, least_count), "words")
    near = words.join(neighbours(words), "word", "left")
    strong = -F.col("best.m") >= ratio * F.col("n")
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"),
    )
    near = scratch.put(near, "near")

    # Counts grow by the ratio with each hop, so chains are short, and halve in each round.
    hops = scratch.put(near.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("to")), "hops")
    while True:
        then = hops.select(F.col("word").alias("to"), F.col("to").alias("then"))
        hops = hops.select("word", "to").join(then, "to", "left")
        hops = scratch.put(hops.select("word", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")), "hops")
        if hops.filter("moved").isEmpty():
            break
    out = near.join(hops, "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))
