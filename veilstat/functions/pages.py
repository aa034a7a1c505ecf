"""Web pages and addresses, as Column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstat import lexicons as lx
from veilstat.functions.text import clean_text

# --- fixed values: patterns ---------------------------------------------------
COMMENT = "(?s)<!--.*?-->"
ANY_TAG = "(?s)<[^>]*>"
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]+)"
IPV4 = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"
LAST_TWO_LABELS = r"([^.]+\.[^.]+)$"
LAST_THREE_LABELS = r"([^.]+\.[^.]+\.[^.]+)$"


def element(tag: str) -> str:
    """An element with its content; an unclosed script or style runs to the end."""
    end = rf"(?:</{tag}\s*>|\z)" if tag in ("script", "style") else rf"</{tag}\s*>"
    return rf"(?is)<{tag}\b[^>]*>.*?{end}"


def inside(tag: str) -> str:
    """From the first opening to the last closing tag of this name."""
    return rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>"


def is_html(c: Column) -> Column:
    low = F.lower(c)
    return low.contains("<html") | low.contains("</p>")


# A character reference, or text up to the next one.
REFERENCE = "&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"
# The bytes 128 to 159 stand for characters of this code page in numeric references.
CODE_PAGE = "windows-1252"


def _numeric(reference: Column) -> Column:
    """The character of ``&#8217;`` or ``&#x2019;``, as browsers read it."""
    digits = F.regexp_replace(reference, "[&#;xX]", "")
    is_hex = F.lower(reference).startswith("&#x")
    # Longer numbers are out of range.
    short = F.length(F.ltrim(digits, F.lit("0"))) <= F.when(is_hex, 6).otherwise(7)
    code = F.when(short, F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits)).try_cast("int")
    page = {b: bytes([b]).decode(CODE_PAGE, "ignore") for b in range(128, 160)}
    listed = F.lit("".join(c or "?" for c in page.values()))
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    gaps = [b for b, c in page.items() if not c]
    return (
        F.when(code.between(128, 159) & ~code.isin(gaps), F.substr(listed, code - 127, F.lit(1)))
        .when(valid, char)
        .otherwise(F.lit("\ufffd"))
    )


def _named(reference: Column) -> Column:
    """The characters of ``&sect;``; old names also count without their semicolon."""
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    name = F.substr(reference, F.lit(2))
    longest = max(len(n) for n in html5 if not n.endswith(";"))
    # From the longest beginning of the name on that is a name itself.
    sizes = F.sequence(F.least(F.length(name), F.lit(longest)), F.lit(2), F.lit(-1))
    starts = F.when(F.length(name) >= 2, F.transform(sizes, lambda n: F.substr(name, F.lit(1), n)))
    start = F.get(F.filter(starts, lambda s: F.map_contains_key(table, s)), 0)
    begun = F.concat(F.try_element_at(table, start), F.substr(name, F.length(start) + 1))
    return F.coalesce(F.try_element_at(table, name), begun, reference)


def decode_entities(c: Column) -> Column:
    """Character references decoded once, from left to right."""
    parts = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))

    def one(part: Column) -> Column:
        return (
            F.when(~part.startswith("&") | (part == "&"), part)
            .when(part == "&amp;", "&")
            .when(part.startswith("&#"), _numeric(part))
            .otherwise(_named(part))
        )

    return F.when(c.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def _visible_text(c: Column, skip: Sequence[str]) -> Column:
    for pattern in (COMMENT, *(element(t) for t in skip), ANY_TAG):
        c = F.regexp_replace(c, pattern, " ")
    return clean_text(decode_entities(c))


def html_to_text_all(c: Column) -> Column:
    """All text of the page, the title too, without scripts and styles."""
    return _visible_text(c, lx.HTML_SKIP_ALL)


def html_to_text_content(c: Column) -> Column:
    """Text of the main part, without page furniture."""
    no_comments = F.regexp_replace(c, COMMENT, " ")
    parts = [F.nullif(F.regexp_extract(no_comments, inside(t), 1), F.lit("")) for t in ("article", "main", "body")]
    return _visible_text(F.coalesce(*parts, no_comments), lx.HTML_SKIP_CONTENT)


def text_or_html(c: Column) -> Column:
    """Main text where the content looks like a page, else the content."""
    return F.when(is_html(c), html_to_text_content(c)).otherwise(c)


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without closing dots; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.trim(url), HOST, 1), r"\.+$", ""))


def registered_domain(url: Column, suffixes: Sequence[str] = lx.TWO_LABEL_SUFFIXES) -> Column:
    """Domain and public suffix of an address, subdomains dropped.

    Knows a fixed list of suffixes; ``domains_by_rules`` goes by a table of rules.
    """
    host = host_of(url)
    two = F.regexp_extract(host, LAST_TWO_LABELS, 1)
    three = F.regexp_extract(host, LAST_THREE_LABELS, 1)
    return (
        F.when(host.rlike(IPV4) | (two == ""), host)
        .when(two.isin(*suffixes) & (three != ""), three)
        .otherwise(two)
    )


def quote_plus(c: Column) -> Column:
    """Query encoding: space to ``+``, ``~`` kept, ``*`` encoded."""
    encoded = F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))
