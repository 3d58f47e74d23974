"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_address(c: Column) -> Column:
    """What follows the last ``wikidot.com/``, without ``.html`` and all after it, and without leading ``../`` steps; null stays null."""
    c = F.substring_index(c, "wikidot.com/", -1)
    return F.regexp_replace(F.regexp_replace(c, r"(?s)\.html.*$", ""), r"(?s)^.*\.\./", "")


def strip_tag(c: Column) -> Column:
    """The decoded tag of a tag address, else null."""
    t = F.regexp_replace(F.regexp_replace(c, "^system_page-tags/tag/", ""), r"(?s)\.html.*$", "")
    return F.when(c.startswith("system_page-tags/tag/"), F.url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))))


def strip_quote(c: Column) -> Column:
    """One pair of ASCII quotes around the text removed."""
    return F.regexp_replace(c, '(?s)^"(.*)"$', "$1")


def split_quote(c: Column) -> Column:
    """Non-empty texts between paired ASCII quotes."""
    return F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1))


def printable_runs(c: Column) -> Column:
    """Runs of printable ASCII, stripped; runs of white space alone are left out."""
    runs = F.regexp_extract_all(c, F.lit(r"[\x20-\x7E\t\n\r\x0B\x0C]+"), F.lit(0))
    return F.filter(F.transform(runs, lambda r: F.regexp_replace(r, r"^[ \t\n\r\x0B\x0C]+|[ \t\n\r\x0B\x0C]+$", "")), lambda r: r != "")


def stable_id(c: Column) -> Column:
    return F.sha2(c, 256)


def normalize_answer(c: Column) -> Column:
    """Lower case, ASCII signs as spaces, no articles, single spaces."""
    c = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\b(a|an|the)\b", " "), r"\s+", " "))


def first_offset(text: Column, term: Column) -> Column:
    """Offset of the first occurrence in code points, -1 without any."""
    return F.instr(text, term) - 1


def triple_of(c: Column) -> Column:
    """``head_relation_tail`` as a struct; the relation may hold underscores."""
    p = F.split(c, "_")
    return F.struct(p[0].alias("head"), F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), "_").alias("relation"), F.element_at(p, -1).alias("tail"))


def triple_text(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat_ws("_", head, relation, tail)


def bracketed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def braced(entries: Column) -> Column:
    """Entries (key, value, an array) as ``{key: [a, b], key: []}``."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), bracketed(e["value"]))), ", "), F.lit("}"))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / F.nullif(b, F.lit(0)), 2))


def safe_percent(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / F.nullif(b, F.lit(0)) * 100, 2))


def unify_name(c: Column) -> Column:
    """Lower case; zeros before a site's number removed."""
    n = F.lower(c)
    return F.when(n.rlike(r"^.*-0+[1-9](-[0-9]*)?$"), F.regexp_replace(n, "0+([1-9])", "$1")).otherwise(n)


def type_by_name(c: Column, kinds: dict[str, str]) -> Column:
    """The kind of the first prefix that the name has, else null."""
    out = F.lit(None).cast("string")
    for prefix, kind in reversed(list(kinds.items())):
        out = F.when(F.lower(c).startswith(prefix), F.lit(kind)).otherwise(out)
    return out


def simplified(c: Column, traditional: str, simple: str) -> Column:
    """Characters of one script variant as those of another, by a table that the caller gives; for phrases see ``functions.phrases``."""
    return F.translate(c, traditional, simple)


def alternation(words: list[str]) -> str:
    """A pattern of any of the words, the longest first, all escaped."""
    import re

    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def substring_eliminated(found: Column) -> Column:
    """Matches that are no proper part of another match."""
    return F.filter(found, lambda m: ~F.exists(found, lambda y: (y != m) & F.contains(y, m)))


def split_selectors(c: Column) -> Column:
    """Selectors of a CSS rule, cut at spaces beside no combinator; commas dropped."""
    return F.filter(F.split(F.replace(c, F.lit(","), F.lit("")), r"(?<![~+>]) (?![~+>])"), lambda s: s != "")


def text_pieces(c: Column, ends: str = "﹒﹔﹖﹗．。！？", closers: str = "\"’”」』", openers: str = "\"‘“「『", flat: bool = False) -> Column:
    """Pieces cut after a terminator and up to two closing quotes, which stay; what begins with an opening quote or a terminator goes on with the piece before.

    With ``flat`` runs of three line ends or more are one, then every white space is a space.
    """
    if flat:
        c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n"), r"(?U)\s", " ")
    marked = F.regexp_replace(c, f"([{ends}][{closers}]{{0,2}}+)(?![{openers}{ends}])", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def lowered(c: Column) -> Column:
    """A text without case and outer space; other values as they are written."""
    return F.lower(F.trim(c.cast("string")))
