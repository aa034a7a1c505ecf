"""Main text of pages by a site style tree: what a site repeats is not the article."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from veilstat.llm.common import text_batches, written

#: Weight of content against presentation, to the power of a node's number of styles.
GAMMA = 0.9
#: Importance below which a branch is removed, outside and inside the article element.
OUTSIDE, INSIDE = 0.2, 0.1
#: Different pages that must share a block before it can count as the site's.
PAGES_OUTSIDE, PAGES_INSIDE = 3, 5
#: Number of pages at which a block's content and a node's styles are measured; with larger
#: hosts the share of pages at which a block goes stays the same.
SCALE = 10
#: Text outside of all article elements, as a multiple of the text inside, from which on they
#: are taken for teasers and the page counts as one without.
TEASER = 3
#: Removed blocks that are broadcast; more are joined with the blocks of the pages.
BROADCAST_BLOCKS = 200_000

# Element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NOISE_TAGS = set(
    "nav footer aside form button select option optgroup datalist fieldset svg canvas object "
    "embed audio video map dialog menu head header noscript template iframe".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = set("ul ol dl table tr select article section div body main aside nav".split())
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
MAIN = {"article", "main"}
# Parts of class, id and role names of what is not an article.
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|"
    r"notices?|alerts?|popup|pop-up|modal|overlay|newsletter|subscri\w*|signup|sign-up|login|sidebar\w*|"
    r"side-?bar|widgets?|menus?|navbar|navigation|nav|breadcrumbs?|masthead|top-?bar|site-header|"
    r"page-header|header|footer|foot|copyright|colophon|legal|comments?|commentlist|disqus|repl(?:y|ies)|respond|"
    r"discussion|share|sharing|social|related|recommend\w*|more-posts|pagination|pager|search|toolbar|"
    r"skip|hidden|sr-only|complementary|contentinfo|dialog)(?:[\s_-]|$)",
    re.IGNORECASE,
)
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
# A section's id inside an article is its anchor, unless it names the readers' comments.
_ANCHOR = re.compile(r"(?<![\w-])id\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_COMMENTS = re.compile(r"comment|respond|disqus|repl(?:y|ies)", re.IGNORECASE)
_HIDDEN = re.compile(
    r"(?:^|\s)hidden(?=[\s=/>]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE
)


class _Element:
    __slots__ = ("tag", "parent", "children", "noise", "main", "holds_main", "style", "key")

    def __init__(self, tag: str, parent: _Element | None, noise: bool):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.children: list[_Element] = []
        self.main = tag in MAIN
        self.holds_main = False
        self.style = self.key = 0


def _noise(tag: str, attributes: str) -> bool:
    if tag in NOISE_TAGS or tag in RAW:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    names = " ".join(a or b or c for a, b, c in _NAME.findall(attributes))
    return bool(NOISE_NAMES.search(names)) or bool(_HIDDEN.search(attributes))


def parse(page: str) -> tuple[_Element, list[tuple[_Element, str, int, int]]]:
    """The element tree, and blocks (block element, text, characters, characters in links)."""
    root = _Element("", None, False)
    at, stack = root, [root]
    blocks: list[tuple[_Element, str, int, int]] = []
    runs: list[str] = []
    linked = anchors = position = 0

    def end_block() -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                owner = at
                while owner.tag in INLINE:
                    owner = owner.parent
                blocks.append((owner, text, len(text), linked))
            runs.clear()
        linked = 0

    def add_text(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            runs.append(text)
            if anchors:
                linked += len(text.strip())

    def pop_to(index: int) -> None:
        nonlocal at, anchors
        for gone in stack[index:]:
            anchors -= gone.tag == "a"
        del stack[index:]
        at = stack[-1]

    while position < len(page):
        found = _TAG.search(page, position)
        if not found:
            add_text(page[position:])
            break
        add_text(page[position : found.start()])
        position = found.end()
        if found.group(1) is not None:
            add_text(found.group(1))
        if not found.group(3):
            continue
        tag = found.group(3).lower()
        if found.group(2):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in INLINE:
                        end_block()
                    pop_to(i)
                    break
                if stack[i].tag in SCOPES and tag in INLINE:
                    break
            continue
        if tag not in INLINE:
            end_block()
        if tag in VOID:
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in CLOSES.get(tag, ()):
                pop_to(i)
                break
            if stack[i].tag in SCOPES or tag not in CLOSES:
                break
        attributes = found.group(4)
        noise = _noise(tag, attributes)
        if tag == "header" and any(e.tag == "article" for e in stack):
            noise = bool(attributes) and _noise("div", attributes)
        if noise and tag == "section" and any(e.main for e in stack):
            anchor = _ANCHOR.search(attributes)
            if anchor and not _COMMENTS.search(anchor.group(0)):
                noise = _noise(tag, _ANCHOR.sub("", attributes))
        one = _Element(tag, at, noise)
        if tag not in INLINE:
            owner = at
            while owner.tag in INLINE:
                owner = owner.parent
            owner.children.append(one)
        if one.main and not noise:
            up = at
            while up is not None and not up.holds_main:
                up.holds_main, up = True, up.parent
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, position)
            position = end.end() if end else len(page)
        elif not attributes.rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append(one)
            at = one
            anchors += tag == "a"
    end_block()
    return root, blocks


def _hash(*parts) -> int:
    return xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def describe(page: str | None, host: str) -> tuple[list, list, list, int]:
    """A page for its site's tree: blocks (key, text), facts (node, kind, value), pages' mark.

    A node is an element at its place in the style tree: a child of a node, of
    the style (sequence of child elements, repeats as one) that its parent has
    here, at a place in that style.  Kinds of facts: 0 the node is there, 1 its
    style, 2 a block outside the article element, 3 one inside.  Blocks that
    their markup names as no article are left out at once.  The mark is that of
    the set of all blocks, so that copies of a page count as one.
    """
    root, blocks = parse(page or "")
    facts: set[tuple[int, int, int]] = set()
    root.key = _hash(host)
    todo = [root]
    while todo:
        one = todo.pop()
        places, runs = [], []
        for child in one.children:
            if not runs or runs[-1] != child.tag:
                runs.append(child.tag)
            places.append(len(runs) - 1)
        one.style = _hash(*runs)
        facts.add((one.key, 0, 0))
        facts.add((one.key, 1, one.style))
        for child, place in zip(one.children, places):
            child.key = _hash(one.key, one.style, place, child.tag)
            if not child.noise or child.holds_main:
                todo.append(child)

    kept = []
    for owner, text, size, linked in blocks:
        inside, dropped, up = False, False, owner
        while up is not None:
            dropped = dropped or (up.noise and not up.holds_main)
            inside = inside or up.main
            up = up.parent
        if not dropped and (inside or linked <= 0.6 * size):
            kept.append((inside, owner, text))
    within = sum(len(text) for inside, _, text in kept if inside)
    if sum(len(text) for inside, _, text in kept if not inside) >= TEASER * within:
        kept = [(False, owner, text) for _, owner, text in kept]
    else:
        kept = [k for k in kept if k[0]]
    out = []
    for inside, owner, text in kept:
        value = _hash(text)
        facts.add((owner.key, 3 if inside else 2, value))
        out.append((owner.key ^ value, text))
    mark = _hash(*sorted({_hash(t) for _, t in out}))
    return [k for k, _ in out], [t for _, t in out], sorted(facts), mark


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): each page's main text.

    Pages of one host are merged into a style tree.  A block's importance is
    made of two entropies over the pages that have its node: that of the node's
    styles, and that of the block's text.  A block that most different pages of
    the host share at the same node is removed, as is what the markup names as
    navigation, advertising, comments and the like.  With a single page there is
    nothing to compare, and the markup decides.

    If a page has an article or main element with text, only that is taken, unless
    the page has three times as much outside: then it is a teaser beside the text,
    and the site's tree judges all blocks alike.
    Text is decoded, white space becomes one space, blocks are joined by one
    space in page order.  Null and empty pages have an empty text; a null url is
    a host of its own; rows with equal or null ``page_id`` are extracted each;
    other columns are ignored; an empty table gives an empty result.
    """
    names = ["row", "page_id", "url", "host", "mark", "keys", "texts", "nodes", "kinds", "values"]
    schema = (
        "row long, page_id long, url string, host long, mark long, keys array<long>, texts array<string>,"
        " nodes array<long>, kinds array<int>, values array<long>"
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, texts, ints = pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), longs, texts, longs, ints, longs]
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = []
                part = batch.slice(start, 512)
                for page_id, url, host, page in zip(*(c.to_pylist() for c in part.columns)):
                    keys, found, facts, mark = describe(page, host)
                    nodes, kinds, values = zip(*facts)
                    number += 1
                    rows.append((number, page_id, url, _hash(host), mark, keys, found, nodes, kinds, values))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), F.col("html").cast("string"))
    parsed = written(text_batches(rows).mapInArrow(each, schema), "pages")

    facts = parsed.select("host", "mark", F.inline(F.arrays_zip("nodes", "kinds", "values")))
    facts = facts.groupBy("host", "nodes", "kinds", "values", "mark").agg(F.lit(1).alias("one"))
    seen = facts.groupBy("host", "nodes", "kinds", "values").agg(F.count("*").alias("n"))
    seen = written(seen, "facts")
    own = seen.filter("kinds = 1").withColumnRenamed("n", "k")
    there = seen.filter("kinds = 0 and n > 1").select("nodes", F.col("n").alias("m"))
    share = F.col("k") / F.col("m")
    styles = own.join(there, "nodes").groupBy("nodes").agg(
        F.first("m").alias("m"),
        F.count("*").alias("styles"),
        F.sum(-share * F.log(share)).alias("entropy"),
    )
    weight = F.pow(F.lit(GAMMA), F.col("styles"))
    shown = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("entropy") / math.log(SCALE)))
    content = F.least(F.lit(1.0), -F.log(F.col("n") / F.col("m")) / math.log(SCALE))
    importance = (1 - weight) * shown + weight * content
    low = seen.filter("kinds >= 2 and n > 1").join(styles, "nodes")
    low = low.filter(
        F.when(F.col("kinds") == 2, (importance < OUTSIDE) & (F.col("n") >= PAGES_OUTSIDE)).otherwise(
            (importance < INSIDE) & (F.col("n") >= PAGES_INSIDE)
        )
    )
    low = written(low.select("host", "nodes", "values"), "low")
    return _without(parsed, low)


def _without(parsed: DataFrame, low: DataFrame) -> DataFrame:
    """Texts of pages without the blocks of ``low``.

    Few blocks are broadcast by host.  Many meet the pages' blocks by their own
    keys, without texts; the pages then get theirs back by row, so nothing is
    joined by host and no list is longer than a page's.
    """
    low = low.select("host", F.col("nodes").bitwiseXOR(F.col("values")).alias("key"))
    if low.count() <= BROADCAST_BLOCKS:
        removed = F.broadcast(low.groupBy("host").agg(F.collect_set("key").alias("removed")))
        joined = parsed.join(removed, "host", "left")
    else:
        shown = parsed.select("row", F.explode(F.array_distinct("keys")).alias("key"))
        gone = shown.join(low.select("key").distinct(), "key", "left_semi")
        joined = parsed.join(gone.groupBy("row").agg(F.collect_list("key").alias("removed")), "row", "left")
    blocks = F.arrays_zip("keys", "texts")
    kept = F.filter(blocks, lambda b: ~F.coalesce(F.array_contains("removed", b["keys"]), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda b: b["texts"]), " ")
    out = joined.select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
