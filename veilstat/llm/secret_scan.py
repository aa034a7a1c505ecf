"""Secrets in texts: patterns find candidates, a random forest removes the false ones.

Everything on the way of the documents is a column expression: candidates are
taken from the words of a row, measured, and scored by the trees written out as
CASE expressions.  Nothing is shuffled, and no Python runs on the executors.
"""

from __future__ import annotations

import json
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from veilstat.llm.common import fresh
from veilstat.operators.classes import quoted

#: A candidate: an unbroken run of token characters that holds a digit; see NAMED and PREFIXED for others.
CANDIDATE = r"[A-Za-z0-9_\-+/=]{12,}"
#: What the text must hold to be looked at word by word.
HINT = r"[A-Za-z_\-+/=]*[0-9][A-Za-z0-9_\-+/=]*"
# Words that name a secret, and words that name harmless values.
SECRET_WORDS = "token|secret|passw|pwd|api_?key|apikey|access_?key|auth|bearer|credential|private"
HARMLESS_WORDS = "commit|sha1|sha256|md5|hash|checksum|digest|uuid|guid|etag|revision|build|card|iban|order|invoice|isbn|doi"
_NAME = rf"(?i)(?:{SECRET_WORDS})[\w\-]*[\"'`\]]*"
#: What stands before a value of any form: a word that names a secret, and = or :.
NAMED = rf"{_NAME}\s?(?::=|=>|[=:])\s?(?:bearer\s)?[\"'`(]*\s*$"
#: The same within a word, and the value behind it.
NAMED_IN_WORD = rf"{_NAME}(?::=|=>|[=:])+(.+)$"
#: Web tokens, which hold dots, and what begins like a key.
WEB_TOKEN = r"eyJ[A-Za-z0-9_\-]*(?:\.[A-Za-z0-9_\-]+)+"
PREFIXED = (
    rf"(?<![A-Za-z0-9])({WEB_TOKEN}|(?:AKIA|ASIA)[A-Z0-9]+"
    r"|(?:gh[opsur]_|sk-|sk_live_|xox[abprs]-|glpat-|AIza)[A-Za-z0-9_\-]+)"
)
#: What one of ``PREFIXED`` contains.
BEGINNINGS = ["eyJ", "AKIA", "ASIA", "gh", "sk-", "sk_", "xox", "glpat-", "AIza"]
# What stands for a value that is elsewhere or missing.
FILLER = (
    r"(?i)^(?:none|null|nil|true|false|undefined|empty|required|optional|string|str|basic|todo|n/a|x+|\*+|\.+|"
    r"your\W?\w*.*|.*(?:change|replace)_?me.*)$|^[<{$%\[(]|environ|getenv|\w\(|^self\."
)
# Common letter groups of words, longest first.
DICTIONARY = (
    "tion|ment|ness|able|ible|less|ship|with|that|this|from|have|will|user|name|file|data|test|"
    "example|sample|index|version|config|admin|the|and|ing|ent|ion|for|her|ter|est|ers|ati|hat|"
    "ate|all|eth|ver|his|ith|ere|con|res|pro|per|com|int|ste|ist|ort"
)
FEATURES = [
    "length", "digits", "upper", "lower", "other", "turns", "case_turns", "vowel_turns",
    "dictionary", "hex_only", "digits_only", "path", "quoted", "assigned", "named", "harmless",
    "prefix", "symbols", "direct", "filler",
]
#: Labelled findings that the default training set has.
FINDINGS = 3000
TREES, DEPTH = 20, 6
THRESHOLD = 0.5
MASK = "[SECRET]"


def _share(text: Column, pattern: str, length: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / length


def measures(found: Column, before: Column, word: Column, after: Column, path: Column) -> list[Column]:
    """The features of a candidate, in the order of ``FEATURES``.

    ``word`` is the run between white space that holds it; ``before`` the two
    words before and ``after`` the one behind.
    """
    length = F.length(found).cast("double")
    steps = F.greatest(length - 1, F.lit(1.0))
    rest = F.length(F.regexp_replace(F.lower(found), DICTIONARY, ""))
    at = F.position(found, word)
    lead = F.substr(word, F.lit(1), at - 1)
    near = F.lower(F.concat_ws(" ", before, lead))
    tail = F.substr(word, at + F.length(found))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        length,
        _share(found, "[0-9]", length),
        _share(found, "[A-Z]", length),
        _share(found, "[a-z]", length),
        _share(found, r"[_\-+/=]", length),
        (
            F.regexp_count(found, F.lit("[0-9](?=[A-Za-z])"))
            + F.regexp_count(found, F.lit("[A-Za-z](?=[0-9])"))
        )
        / steps,
        F.regexp_count(found, F.lit("[a-z](?=[A-Z])")) / steps,
        F.regexp_count(F.lower(found), F.lit("[aeiouy](?=[b-df-hj-np-tv-xz])")) / steps,
        1 - rest / length,
        flag(found.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        flag(found.rlike("^[0-9]+$")),
        flag(lead.rlike(r"[/.\\@]$") | tail.rlike(r"^[./@\\]\w") | lead.rlike("://") | found.rlike("^[^=+]*/[^=+]*/") | path.rlike("(?i)test|example|fixture|sample")),
        flag(lead.rlike("[\"'`]$") & tail.rlike("^[\"'`]")),
        flag(near.rlike("[=:]\\s*[\"'`]?\\s*$")),
        flag(near.rlike(SECRET_WORDS)),
        flag(near.rlike(HARMLESS_WORDS)),
        flag(found.rlike(f"^{PREFIXED}")),
        _share(found, r"[^A-Za-z0-9_\-+/=]", length),
        flag(near.rlike(NAMED)),
        flag(found.rlike(FILLER)),
    ]


def labelled_findings(count: int = FINDINGS, seed: int = 5) -> list[Row]:
    """Findings as a reviewer would label them: drawn from forms of secrets and of lookalikes."""
    draw = random.Random(seed)
    hexa, digit = "0123456789abcdef", "0123456789"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    syllables = "th in er an on re ou ment que eau tion en der ung sch los de ci ó ti es at is".split()

    def run(letters: str, low: int, high: int | None = None) -> str:
        return "".join(draw.choice(letters) for _ in range(draw.randint(low, high or low)))

    def prose() -> str:
        return "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))

    def secret() -> str:
        kind = draw.randrange(7)
        if kind < 3:
            return run(hexa, draw.choice([32, 40, 48, 64]))
        return [
            run(upper + lower + digit, 20, 48), run(upper + lower + digit + "+/", 40),
            draw.choice(["AKIA", "ASIA"]) + run(upper + digit, 16),
            draw.choice(["ghp_", "sk-", "sk_live_", "xoxb-", "glpat-", "AIza"]) + run(upper + lower + digit, 24, 40),
        ][kind - 3]

    def lookalike() -> tuple[str, str]:
        kind = draw.randrange(9)
        if kind < 2:
            return run(digit, draw.randint(12, 20)), draw.choice(["", "card ", "order ", "isbn "])
        if kind == 2:
            return "-".join(run(hexa, n) for n in (8, 4, 4, 4, 12)), draw.choice(["uuid = ", "id: ", ""])
        if kind == 3:
            return run(hexa, draw.choice([32, 40, 64])), draw.choice(["commit ", "sha256: ", "md5 = ", "checksum ", "etag: "])
        if kind == 4:
            return "-".join([prose(), prose(), run(digit, 1, 4)]).replace("ó", "o") + "-page", "see "
        if kind == 5:
            return "/".join([prose(), prose() + run(digit, 1, 3), prose()]).replace("ó", "o"), "https://x.example.com/"
        if kind == 6:
            return "==========" + run(digit, 1, 3) + "==", ""
        if kind == 7:
            return (prose() + prose() + prose()).replace("ó", "o") + run(digit, 1, 4), draw.choice(["", "version = "])
        return run(digit, 4) + "-" + run(digit, 2) + "-" + run(digit, 2) + "T" + run(digit, 6), "at "

    def phrase() -> str:
        kind = draw.randrange(6)
        if kind == 0:
            return draw.choice("-_.").join(prose() for _ in range(draw.randint(2, 4)))
        if kind == 1:
            return run(upper + lower + digit + "!@#$%&*.:?", 6, 24)
        if kind == 2:
            return prose() + draw.choice(["!", "@", "#", "$", ""]) + run(digit, 1, 4) + draw.choice(["", "!", "?"])
        if kind == 3:
            return run(upper + lower, 6, 32)
        if kind == 4:
            return run(upper + lower + digit, 6, 19)
        return prose().capitalize() + draw.choice("!@#$.:") + prose() + run(digit, 0, 3)

    def begun() -> str:
        letters = upper + lower + digit + "_-"
        if draw.random() < 0.5:
            return "eyJ" + ".".join([run(letters, 10, 40), "eyJ" + run(letters, 10, 90), run(letters, 20, 43)])
        return draw.choice(["AKIA", "ASIA"]) + run(upper, 16)

    def named() -> str:
        return draw.choice(["token", "secret", "password", "passwd", "pwd", "api_key", "db_password", "access_key", "client_secret", "auth_token"])

    def filler() -> str:
        return draw.choice([
            "None", "null", "true", "false", "required", "optional", "undefined", "string", "xxxx", "****", "...",
            "your_" + prose(), "YOUR_TOKEN_HERE", "changeme", "${" + prose().upper() + "}", "<" + prose() + ">", "{{" + prose() + "}}",
            'os.environ["' + prose().upper() + '"]', "getenv(" + prose() + ")", "self." + prose(), prose() + "()",
        ])

    def other(secret: int) -> Row:
        # Values of any form: known by the naming word or their beginning; and what only looks so.
        quote = draw.choice(["", '"', "'"])
        before, word = f"{prose()} {prose()}", ""
        if secret and draw.random() < 0.25:
            found = begun()
            if draw.random() < 0.5:
                before = f"{prose()} {named()}:"
            word = quote + found + quote
        elif secret:
            found, form, at = phrase(), draw.randrange(3), draw.choice("=:")
            word = quote + found + quote + draw.choice(["", "", ";", ","])
            before, word = [
                (f"{named()} {at}", word), (f"{prose()} {named()}{at}", word), (before, f"{named()}{at}{word}"),
            ][form]
        elif draw.random() < 0.25:
            found = draw.choice(["sk-" + prose(), "ASIAN", "ASIA" + run(upper, 1, 4), "sk-learn", "eyJ." + prose()]).replace("ó", "o")
            word = found + draw.choice(["", ".", ","])
        elif draw.random() < 0.6:
            found, at = filler(), draw.choice("=:")
            quote = quote if draw.random() < 0.3 and '"' not in found else ""
            word = quote + found + quote + draw.choice(["", "", ","])
            before, word = draw.choice([(f"{named()} {at}", word), (f"{prose()} {named()}{at}", word), (before, f"{named()}{at}{word}")])
        else:
            found = draw.choice([prose(), prose(), run(digit, 1, 4), "must", "the", "this"])
            before, word = f"{prose()} {named()}{draw.choice(['', 's'])}:", found + draw.choice(["", "", ",", "."])
        return Row(found=found, before=before, word=word, after=prose(), path=f"src{draw.randrange(20)}", secret=secret)

    rows = []
    for i in range(count):
        if i % 6 > 3:
            rows.append(other(i % 2))
            continue
        if i % 2:
            found = secret()
            if draw.random() < 0.15 and not any(c in found for c in "_-"):
                found = found.upper()
            name = draw.choice(["token", "secret", "password", "api_key", "auth_token", "access_key", "client_secret", "bearer"])
            quote = draw.choice(["", '"', "'"])
            tail = draw.choice(["", "", ";", "!!", "###", "$$$", "%%%", ","])
            form = draw.randrange(4)
            if form == 0:
                before, word = f"{name} =", f"{quote}{found}{quote}{tail}"
            elif form == 1:
                before, word = f"{prose()} {name}:", f"{quote}{found}{quote}{tail}"
            elif form == 2:
                before, word = f"{prose()} {prose()}", f"{name}={quote}{found}{quote}{tail}"
            elif found.startswith(("AKIA", "ASIA", "ghp_", "sk", "xoxb", "glpat", "AIza")):
                before, word = f"{prose()} {prose()}", found + tail
            else:
                before, word = f"{name}: bearer", found + tail
            if draw.random() < 0.2:
                before = before.upper()
        else:
            found, lead = lookalike()
            tail = draw.choice(["", "", ".", ",", "!!", "***", "&&&", ".html"])
            if lead.endswith("/"):
                before, word = f"{prose()} {prose()}", lead + found + tail
            else:
                before, word = f"{prose()} {lead}".strip(), found + tail
        rows.append(Row(found=found, before=before, word=word, after=prose(), path=f"src{i % 20}", secret=i % 2))
    return rows


def assembled(findings: DataFrame) -> DataFrame:
    """(label, features) of labelled findings."""
    from pyspark.ml.feature import VectorAssembler

    columns = measures(*(F.col(c) for c in ("found", "before", "word", "after", "path")))
    rows = findings.select(
        F.col("secret").cast("double").alias("label"),
        *[c.cast("double").alias(n) for n, c in zip(FEATURES, columns)],
    )
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def forest(spark: SparkSession, findings: DataFrame | None = None):
    """A random forest over labelled findings.

    ``findings`` has columns found, before, word, after, path and secret (0 / 1);
    at most a few thousand rows are meant, as every one is read at once.
    """
    from pyspark.ml.classification import RandomForestClassifier

    if findings is None:
        text = json.dumps([r.asDict() for r in labelled_findings()])
        kind = "array<struct<found:string,before:string,word:string,after:string,path:string,secret:int>>"
        findings = spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))
    learner = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3, minInstancesPerNode=3)
    return learner.fit(assembled(findings).select("label", "features"))


def trees_of(model) -> list:
    """The trees of a forest as nested tuples; leaves are shares of secrets."""

    def node(java) -> tuple | float:
        if java.getClass().getSimpleName() == "LeafNode":
            stats = list(java.impurityStats().stats())
            return stats[1] / sum(stats)
        split = java.split()
        return split.featureIndex(), split.threshold(), node(java.leftChild()), node(java.rightChild())

    return [node(tree._call_java("rootNode")) for tree in model.trees]


def train(spark: SparkSession, findings: DataFrame | None = None) -> list:
    """The trees of a forest over ``findings``, see ``forest``."""
    return trees_of(forest(spark, findings))


def probability(trees: list, features: Column) -> Column:
    """The forest's share of votes for "secret", from a struct of ``FEATURES``."""

    def tree(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        feature, at, left, right = node
        if left == right:
            return tree(left)
        return F.when(features[FEATURES[feature]] <= at, tree(left)).otherwise(tree(right))

    total = tree(trees[0])
    for one in trees[1:]:
        total = total + tree(one)
    return total / len(trees)


def candidates_in(x: Column) -> Column:
    """(found, before, word, after, place) of the candidates of a word; ``x`` has its neighbours too.

    ``x`` is a struct (word, place, second, first, after): the word, its number,
    the two words before and the one behind.
    """
    before = F.concat_ws(" ", x.second, x["first"])

    def value_in(rest: Column) -> Column:
        """The value that starts ``rest``: what is in its quotes, or all but the marks around it."""
        plain = F.regexp_replace(rest, "^[\"'`(]+|[\"'`;,)\\]}]+$", "")
        quoted = F.regexp_extract(rest, "^[\"'`(]*[\"'`](.+?)[\"'`]", 1)
        return F.when(quoted != "", quoted).otherwise(plain)

    begun = F.regexp_extract_all(x.word, F.lit(PREFIXED), F.lit(1))
    runs = F.regexp_extract_all(F.regexp_replace(x.word, WEB_TOKEN, " "), F.lit(f"({CANDIDATE})"), F.lit(1))
    runs = F.transform(runs, lambda r: F.regexp_replace(r, "^[A-Za-z_]+=+(?=.{12})", ""))
    runs = F.array_union(F.filter(runs, lambda r: r.rlike("[0-9]")), begun)
    value = value_in(F.when(_behind_name(x), x.word).otherwise(F.regexp_extract(x.word, NAMED_IN_WORD, 1)))
    bare = F.regexp_replace(value, r"^[^A-Za-z0-9_\-+/=]+|[^A-Za-z0-9_\-+/=]+$", "")
    # Marks around a run are no part of it.
    named = F.filter(F.array(value), lambda v: (v != "") & ~F.array_contains(runs, bare))
    runs = F.array_union(runs, named)
    return F.transform(
        runs,
        lambda r: F.struct(
            r.alias("found"), before.alias("before"), x.word.alias("word"),
            F.coalesce(x.after, F.lit("")).alias("after"), x.place.alias("place"),
        ),
    )


def _behind_name(x: Column) -> Column:
    """Whether what stands before the word names a secret; most words have no = or : there."""
    before = F.concat_ws(" ", x.second, x["first"], F.lit(""))
    return _contains(before, "=", ":") & before.rlike(NAMED)


def _contains(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def with_candidates(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """``docs`` with the words of ``text`` that hold a candidate, next to their neighbours, as ``name``.

    The text is split once, into a column of its own: no lambda goes back to it,
    so the work is in proportion to the words.
    """
    # Most texts and words fail the short test that stands before each pattern.
    looked = (
        (text.rlike("[0-9]") & text.rlike(CANDIDATE))
        | (_contains(text, "=", ":") & text.rlike(_NAME + r"\s*[=:]"))
        | (_contains(text, *BEGINNINGS) & text.rlike(PREFIXED))
    )
    none = F.array().cast("array<string>")
    held = fresh(docs, "words")
    docs = docs.withColumn(held, F.when(F.coalesce(looked, F.lit(False)), F.split(text, r"\s+")).otherwise(none))
    words = F.col(held)
    nothing = F.lit(None).cast("string")
    zipped = F.arrays_zip(
        words, F.sequence(F.lit(0), F.size(words) - 1), F.concat(F.array(nothing, nothing), words),
        F.concat(F.array(nothing), words), F.slice(words, F.lit(2), F.size(words)),
    ).cast("array<struct<word:string,place:bigint,second:string,first:string,after:string>>")

    def holds(x: Column) -> Column:
        run = (F.length(x.word) >= 12) & x.word.rlike("[0-9]") & x.word.rlike(CANDIDATE)
        named = _contains(x.word, "=", ":") & x.word.rlike(NAMED_IN_WORD)
        begun = _contains(x.word, *BEGINNINGS) & x.word.rlike(PREFIXED)
        return run | _behind_name(x) | named | begun

    # What is behind the last word has none.
    marked = F.filter(zipped, lambda x: x.word.isNotNull() & holds(x))
    return docs.withColumn(name, marked).drop(held)


def with_findings(docs: DataFrame, text: Column, path: Column, trees: list, threshold: float, name: str) -> DataFrame:
    """``docs`` with an array ``name`` of (found, place, score): candidates at the threshold.

    ``place`` is the number of the word.  A finding that is part of another one
    in the same word is left out.
    """
    held = fresh(docs, "marked")
    docs = with_candidates(docs, text, held)

    def measured(c: Column) -> Column:
        values = measures(c.found, c.before, c.word, c.after, path)
        named = [v.cast("double").alias(n) for n, v in zip(FEATURES, values)]
        return F.struct(c.found.alias("found"), c.place.alias("place"), F.struct(*named).alias("f"))

    def scored(c: Column) -> Column:
        return F.struct(c.found.alias("found"), c.place.alias("place"), probability(trees, c.f).alias("score"))

    def of_word(x: Column) -> Column:
        found = F.transform(F.transform(candidates_in(x), measured), scored)
        return F.filter(found, lambda s: s.score >= threshold)

    part = lambda a, b: (a.found != b.found) & F.contains(b.found, a.found)
    whole = lambda found: F.filter(found, lambda a: ~F.exists(found, lambda b: part(a, b)))
    found = F.flatten(F.transform(F.transform(held, of_word), whole))
    return docs.withColumn(name, found).drop(held)


def _path(docs: DataFrame, path: str) -> Column:
    given = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    return F.coalesce(given, F.lit(""))


def scan(docs: DataFrame, trees: list, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, place, finding, score): candidates that the forest takes for secrets.

    Candidates are runs of 12 or more letters, digits and ``_-+/=`` with a digit
    among them, what begins like a known key, and any word behind a name of
    secrets with = or : (up to white space).  Null and empty texts have none; rows with equal or null
    ``doc_id`` are scanned each; ``path`` may be missing or null; other columns
    are ignored; an empty table gives an empty result.  A candidate that occurs
    twice in one word is reported once.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        _path(docs, path).alias("path"),
    )
    rows = with_findings(rows, F.col("text"), F.col("path"), trees, threshold, "found")
    # The outer form: else Spark would look for texts with findings first, and scan each of them again.
    rows = rows.select("doc_id", F.explode_outer("found").alias("s")).filter("s is not null")
    return rows.select("doc_id", "s.place", F.col("s.found").alias("finding"), "s.score")


def redact(docs: DataFrame, trees: list, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mask; rows and columns stay.

    ``n_chars``, if there, is counted anew for texts that changed.
    """
    held, clean = fresh(docs, "found"), fresh(docs, "clean")
    out = with_findings(docs, F.col("text"), _path(docs, path), trees, threshold, held)
    secrets = F.array_distinct(F.transform(held, lambda s: s.found))
    longest = F.array_sort(secrets, lambda a, b: (F.length(b) - F.length(a)).cast("int"))
    # A short one may be part of other words.
    alone = lambda s: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), s, F.lit(r"\E(?![A-Za-z0-9])"))
    masked = lambda t, s: F.when(
        (F.length(s) >= 12) | F.contains(s, F.lit(r"\E")), F.replace(t, s, F.lit(MASK))
    ).otherwise(F.regexp_replace(t, alone(s), F.lit(MASK)))
    text = F.aggregate(longest, F.col("text"), masked)
    out = out.withColumn(clean, text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        same = F.col(clean).eqNullSafe(F.col("text"))
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length(clean).cast(kind)))
    return out.withColumn("text", F.col(clean)).select(*[quoted(c) for c in docs.columns])
