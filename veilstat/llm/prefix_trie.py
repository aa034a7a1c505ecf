"""Conversations that begin alike: a z-fast trie of their turns, grown in batches.

A node of the compacted trie stands for a prefix at which conversations part or
end; the turns between it and its parent are its edge.  It is found by its
handle: the prefix whose length is the two-fattest number of the edge, the one
that most powers of two divide.  A conversation finds the edge at which it leaves
the trie by binary search over such lengths, in as many rounds as its length has
bits.  Prefixes are compared by 128-bit chained digests, never by their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstat.llm.common import Scratch

#: Node of the empty prefix.
ROOT = b""
#: Of each eight conversations so many are in the trie after each batch.
BATCHES = (1, 3, 8)
#: Turns that a rebuilt conversation can take from another.
MOST_LENT = 8
#: Ids that are hashed as one piece.
PIECE = 1 << 13


def _root() -> Column:
    return F.lit(bytearray(ROOT))


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, rank, digest, n_bytes): turns in order; texts go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    ).filter(F.col("conv_id").isNotNull())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("rank"), "digest", "n_bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Like ``turn_digests``, with the first turns of each conversation taken from its leader.

    The leader of ``c`` is ``c - c % 5``; the first crc32(c) % 9 turns are the
    leader's (all it has, if fewer), the others its own.  ``part`` is 0 for lent turns.
    """
    ids = turns.select("conv_id").distinct()
    lent_to = lambda c: F.crc32(c.cast("string").cast("binary")) % 9
    own = turns.filter(F.col("rank") >= lent_to(F.col("conv_id"))).withColumn("part", F.lit(1))
    first = turns.filter((F.col("rank") < MOST_LENT) & (F.col("conv_id") % 5 == 0))
    near = F.explode(F.array(*[F.lit(k).cast("long") for k in range(-4, 5)])).alias("k")
    lent = first.select("*", near).withColumn("to", F.col("conv_id") + F.col("k"))
    lent = lent.filter((F.col("to") - F.col("to") % 5 == F.col("conv_id")) & (F.col("rank") < lent_to(F.col("to"))))
    lent = lent.join(ids.select(F.col("conv_id").alias("to")), "to", "left_semi")
    lent = lent.select(F.col("to").alias("conv_id"), "rank", "digest", "n_bytes", F.lit(0).alias("part"))
    return own.unionByName(lent)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, hash, next, n_bytes, total): every prefix of every conversation.

    ``next`` is the digest of the next longer one, null at the end; ``total`` the
    bytes of all turns so far.  A conversation passes through one task in order,
    as a chain has to, a row at a time.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, d, total, held = None, ROOT, 0, 0, None
        schema = pa.schema([("conv_id", pa.int64()), ("d", pa.int32()), ("hash", pa.binary()), ("next", pa.binary()), ("n_bytes", pa.int64()), ("total", pa.int64())])
        for batch in batches:
            rows = []
            for conv, digest, size in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now:
                    now, state, d, total = conv, ROOT, 0, 0
                    if held:
                        rows.append(held)
                    held = None
                state = hashlib.blake2b(state + digest, digest_size=16).digest()
                d, total = d + 1, total + size
                if held:
                    rows.append((*held[:3], state, *held[4:]))
                held = (conv, d, state, None, size, total)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(held, schema)], schema=schema)

    order = [c for c in ("conv_id", "part", "rank") if c in turns.columns]
    dealt = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "digest", "n_bytes")
    return dealt.mapInArrow(each, "conv_id long, d int, hash binary, next binary, n_bytes long, total long")


def two_fattest(low: str, high: str) -> Column:
    """Of the numbers in (low, high], the one that the largest power of two divides."""
    bits = f"length(bin(bigint({low} ^ {high}))) - 1"
    return F.expr(f"shiftleft(shiftright({high}, {bits}), {bits})")


def _at(found: DataFrame, rep: str, d: str, rows: DataFrame, **columns: str) -> DataFrame:
    """``found`` with columns of the prefix at (rep, d); null for the empty prefix."""
    there = rows.select(F.col("conv_id").alias("_c"), F.col("d").alias("_d"), *[F.col(c).alias(n) for n, c in columns.items()])
    return found.join(there, (F.col(rep) == F.col("_c")) & (F.col(d) == F.col("_d")), "left").drop("_c", "_d")


def _named(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes (rep, len, plen) with digests of themselves, parent, handle and the first turn of the edge."""
    nodes = nodes.withColumn("fat", two_fattest("plen", "len"))
    at = {"node": F.col("len"), "parent": F.col("plen"), "handle": F.col("fat"), "first": F.col("plen") + 1}
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), d.alias("d")) for n, d in at.items()])).alias("q")
    found = _at(nodes.select("*", asked).select("rep", "len", "plen", "fat", "q.*"), "rep", "d", rows, hash="hash")
    named = [F.max(F.when(F.col("name") == n, F.col("hash"))).alias(n) for n in at]
    found = found.groupBy("rep", "len", "plen", "fat").agg(*named)
    return found.withColumn("parent", F.coalesce("parent", _root()))


def locate(batch: DataFrame, nodes: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, node, plen, len, rep, lcp): where each conversation of ``batch`` leaves the trie.

    ``lcp`` turns of it are in the trie, the last of them on the edge of ``node``
    (the root's: zero).  Round k looks at prefixes whose length 2^k divides, so
    all rounds together read about twice the prefixes there are.
    """
    edge = F.struct("node", "plen", "len", "rep")
    none = F.struct(_root().alias("node"), F.lit(0).alias("plen"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("rep"))
    state = batch.filter(F.col("next").isNull()).select("conv_id", F.lit(0).alias("a"), F.col("d").alias("b"), none.alias("exit"))
    longest = state.agg(F.max("b")).first()[0] or 0

    def look(state: DataFrame, at: Column, prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
        """``state`` with ``hit``: the edge whose ``key`` is the prefix of length ``at`` (null: none)."""
        there = prefixes.select(F.col("conv_id").alias("c"), "d", "hash")
        state = state.withColumn("at", at).join(there, (F.col("conv_id") == F.col("c")) & (F.col("at") == F.col("d")), "left")
        # Those that ask nothing are kept apart by their ids.
        state = state.withColumn("ask", F.coalesce("hash", F.lpad(F.col("conv_id").cast("string"), 24, " ").cast("binary")))
        return state.join(nodes, F.col("ask") == F.col("key"), "left").drop("c", "d", "hash", "ask", "key")

    handles = nodes.select(F.col("handle").alias("key"), edge.alias("hit"))
    for k in reversed(range(longest.bit_length())):
        fat = F.col("b").bitwiseAND(F.lit(-(1 << k)))
        state = look(state, F.when(fat > F.col("a"), fat), batch.filter(F.col("d") % (1 << k) == 0), handles).select(
            "conv_id",
            F.coalesce("hit.len", "a").alias("a"),
            F.when(F.col("at").isNotNull() & F.col("hit").isNull(), F.col("at") - 1).otherwise(F.col("b")).alias("b"),
            F.coalesce("hit", "exit").alias("exit"),
        )
        if k % 4 == 3:
            state = scratch.put(state, "search")
    # Behind the last node found, the edge that begins with the next turn, if there is one.
    state = look(state, F.col("a") + 1, batch, nodes.select(F.col("first").alias("key"), edge.alias("hit")))
    state = state.select("conv_id", F.coalesce("hit", "exit").alias("exit"))
    state = scratch.put(state.select("conv_id", "exit.*"), "exits")

    # How far along that edge: both are compared turn by turn.
    along = batch.select("conv_id", "d", "hash").join(state, "conv_id").filter("d > plen and d <= len")
    along = _at(along, "rep", "d", rows, there="hash").filter("hash = there")
    shared = along.groupBy("conv_id").agg(F.max("d").alias("lcp"))
    return state.join(shared, "conv_id", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0)))


def _tail_nodes(tails: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, len, plen): where ``tails`` (conv_id, d, hash, next, lcp), the parts behind the trie, fork or end."""
    grown = tails.groupBy("hash").agg(
        F.min("conv_id").alias("rep"), F.min("next").alias("low"), F.max("next").alias("high"),
        (F.count("next") < F.count(F.lit(1))).alias("ends"),
    )
    grown = scratch.put(grown.filter("ends or low <> high").select("hash", "rep"), "grown")
    standing = grown.select(F.col("rep").alias("conv_id")).distinct()
    paths = tails.join(standing, "conv_id", "left_semi").join(grown, "hash")
    upper = F.lag("d").over(Window.partitionBy("conv_id").orderBy("d"))
    paths = paths.select("conv_id", "rep", F.col("d").alias("len"), F.coalesce(upper, "lcp").alias("plen"))
    return paths.filter("conv_id = rep").select("rep", "len", "plen")


def insert(batch: DataFrame, nodes: DataFrame | None, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie with the conversations of ``batch``: edges split where they leave, and their own tails."""
    turns = batch.select("conv_id", "d", "hash", "next")
    if nodes is None:
        return _named(_tail_nodes(turns.withColumn("lcp", F.lit(0)), scratch), rows)
    exits = scratch.put(locate(batch, nodes, rows, scratch), "located")
    tails = turns.join(exits.select("conv_id", "lcp"), "conv_id").filter("d > lcp")
    paths = _tail_nodes(scratch.put(tails, "tails"), scratch)

    splits = exits.filter("plen < lcp and lcp < len").select("node", "plen", F.col("lcp").alias("len"), "rep")
    split = scratch.put(splits.distinct(), "splits")
    broken = split.select("node").distinct()
    pieces = split.unionByName(nodes.join(broken, "node", "left_semi").select("node", "plen", "len", "rep"))
    upper = F.lag("len").over(Window.partitionBy("node").orderBy("len"))
    pieces = pieces.select("rep", "len", F.coalesce(upper, "plen").alias("plen"))
    return nodes.join(broken, "node", "left_anti").unionByName(_named(pieces.unionByName(paths), rows))


def build(rows: DataFrame, scratch: Scratch, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """(node, len, plen, fat, rep, parent, handle, first): the compacted trie without its root."""
    nodes, before = None, 0
    number = F.pmod(F.xxhash64("conv_id"), F.lit(batches[-1]))
    for until in batches:
        batch = rows.filter((number >= before) & (number < until))
        nodes, before = scratch.put(insert(batch, nodes, rows, scratch), "nodes"), until
    scratch.drop("search", "exits", "located", "splits", "tails", "grown")
    return nodes


def id_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids of each node, ascending, joined by commas.

    Ids are dealt by ranges of (node, id), so that those of a node that ends a
    third of all conversations are joined in many tasks; one task then hashes
    their pieces, a piece at a time.
    """
    most = PIECE

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            columns = [pa.array([now], pa.binary()), pa.array(ids[:1], pa.int64()), pa.array([",".join(map(str, ids))])]
            return pa.RecordBatch.from_arrays(columns, names=["node", "least", "ids"])

        now, ids = None, []
        for batch in batches:
            for node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if node != now or len(ids) >= most:
                    if ids:
                        yield out()
                    now, ids = node, []
                ids.append(conv)
        if ids:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

        now, state = None, None
        for batch in batches:
            for node, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node != now:
                    if state:
                        yield out()
                    now, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state:
            yield out()

    order = ["node", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(join, "node binary, least long, ids string")
    pieces = pieces.repartition("node").sortWithinPartitions("node", "least")
    return pieces.mapInArrow(digest, "node binary, ends_sha256 string")


def subtrees(nodes: DataFrame, sums: list[str], scratch: Scratch) -> DataFrame:
    """``nodes`` (node, parent, sums, low) with sums, and the least ``low``, over their subtrees.

    Each round adds what hangs twice as far below; as many rounds as the height has bits.
    """
    above = F.when(F.col("parent") != _root(), F.col("parent"))
    state = scratch.put(nodes.select("node", above.alias("up"), "low", *sums), "sums")
    while not state.filter("up is not null").isEmpty():
        below = state.filter("up is not null").groupBy("up").agg(F.min("low").alias("_low"), *[F.sum(c).alias(f"_{c}") for c in sums])
        more = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]
        further = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        added = state.join(below.withColumnRenamed("up", "node"), "node", "left")
        added = added.select("node", "up", F.least("low", "_low").alias("low"), *more)
        state = scratch.put(added.join(further, "up", "left").select("node", F.col("next").alias("up"), "low", *sums), "sums")
    return state.drop("up")


def prefix_nodes(turns: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """One row per distinct beginning of the conversations in ``turns`` (conv_id, digest, n_bytes, in order).

    Turnless conversations have one row with a null digest.  Columns: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, see ``trie``.
    """
    scratch = Scratch(turns.sparkSession)
    turns = scratch.put(turns, "turns")
    rows = scratch.put(prefixes(turns.filter(F.col("digest").isNotNull())), "prefixes")
    empty = turns.filter(F.col("digest").isNull()).select("conv_id")
    nodes = build(rows, scratch, batches)

    # What ends at each node, then over its subtree.
    ended = rows.filter(F.col("next").isNull()).select(F.col("hash").alias("node"), "conv_id", "total")
    own = ended.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.sum("total").alias("bytes"))
    forks = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    full = _at(_at(nodes, "rep", "len", rows, total="total"), "rep", "plen", rows, before="total")
    full = full.join(own, "node", "left").join(forks, "node", "left").select(
        "node", "parent", "rep", "len", "plen", zero("before"), "low", zero("n"), zero("bytes"), zero("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"),
        (F.col("total") - F.coalesce("before", F.lit(0))).alias("edges"),
    )
    full = scratch.put(full, "full")
    sums = ["n", "bytes", "n_leaves", "edges"]
    below = subtrees(full.select("node", "parent", "low", *sums), sums, scratch)
    shas = id_hashes(ended.select("node", "conv_id").unionByName(empty.select(_root().alias("node"), "conv_id")))
    whole = full.select("node", "parent", "rep", "len", "plen", "before", "n_children").join(below, "node")
    whole = whole.join(shas, "node", "left")
    whole = scratch.put(whole, "whole")

    # Every member brings its turns from here on, of which each node keeps one.
    def saved(at: Column) -> Column:
        return F.col("bytes") - F.col("n") * at - (F.col("edges") - (at - F.col("before")))

    none = hashlib.sha256().hexdigest()
    tops = whole.filter("plen = 0")
    crown = tops.agg(
        F.min("low").alias("low"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum(saved(F.lit(0))).alias("saved"),
    ).crossJoin(empty.agg(F.min("conv_id").alias("empty_low"), F.count(F.lit(1)).alias("empty_n")))
    root = crown.select(
        F.least("low", "empty_low").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), (F.coalesce("n", F.lit(0)) + F.col("empty_n")).alias("n_convs"),
        F.col("n_children"), F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
    ).filter("n_convs > 0")
    root = scratch.put(root, "root").join(shas.filter(F.col("node") == _root()).select("ends_sha256"), how="left")
    first = root.select("conv_id").first()
    least = F.lit(first[0] if first else None).cast("long")

    # Edges expanded along the conversation that stands for each node.
    parents = whole.select(F.col("node").alias("parent"), F.col("low").alias("parent_low"))
    marks = whole.join(parents, "parent", "left").withColumn("parent_low", F.coalesce("parent_low", least))
    marks = marks.select(F.col("rep").alias("conv_id"), F.col("len").alias("d"), F.struct(*marks.columns).alias("mark"))
    steps = rows.select("conv_id", "d", "n_bytes", "total").join(marks.select("conv_id").distinct(), "conv_id", "left_semi")
    steps = steps.join(marks, ["conv_id", "d"], "left")
    down = Window.partitionBy("conv_id").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.select("d", "n_bytes", "total", F.last("mark", ignorenulls=True).over(down).alias("mark"))
    steps = steps.filter("d > mark.plen").select("d", "n_bytes", "total", "mark.*")
    at_node = F.col("d") == F.col("len")
    expanded = steps.select(
        F.col("low").alias("conv_id"), F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") == F.col("plen") + 1, F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(at_node, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves", saved(F.col("total") - F.col("n_bytes")).alias("saved_tokens"),
        F.when(at_node & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(none).alias("ends_sha256"),
    )
    return expanded.unionByName(root.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))))


def trie(conversations: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """Nodes of all distinct beginnings of the rebuilt conversations, the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): the smallest member and its parent's, members, children,
    childless nodes below, the bytes that members share from here on, and the
    SHA-256 of the ids that end here.

    Turns are ordered by ``turn``, null first; of equal ones the order is that of
    the digests of role and text.  Null roles and texts are empty, repeated rows
    are turns of their own, rows with a null ``conv_id`` belong to no conversation
    and are left out, other columns are ignored.  Ids below zero have the leader
    nearer to zero.  An empty table gives an empty result, without a root.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.put(turn_digests(conversations), "ranked")
    mended = rebuilt(turns)
    ids = turns.select("conv_id").distinct()
    # A conversation may be left without a turn.
    turnless = ids.join(mended.select("conv_id").distinct(), "conv_id", "left_anti")
    fill = {"rank": "int", "digest": "binary", "n_bytes": "long", "part": "int"}
    turnless = turnless.select("conv_id", *[F.lit(None).cast(kind).alias(c) for c, kind in fill.items()])
    return prefix_nodes(mended.unionByName(turnless), batches)
