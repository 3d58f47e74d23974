"""Texts of object pages by a chain of rules, of which the first that finds a text wins; canon pages to rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.html import Node, content_of, page_blocks, parse
from graphloom.functions.slices import sliced
from graphloom.operators import hubs

# What the two texts of an object begin with, and the classes of blocks that hold them without a keyword.
KEYWORDS = [("特殊收容措施", "描述")]
CLASSES = ("blbf-special-containment-procedures", "blbf-description")
#: A description line of fewer characters is but a heading.
SHORT = 5


@dataclass
class ObjectPages:
    """An object's pages in order, each parsed once for all rules; ``main`` is the one whose lines are read."""

    html: list[str | None]
    main: int = 0
    keywords: list[tuple[str, str]] = field(default_factory=lambda: KEYWORDS)
    classes: tuple[str, str] = CLASSES

    def __post_init__(self) -> None:
        self.blocks = [page_blocks(h) for h in self.html]


def by_keyword(p: ObjectPages) -> tuple[str | None, str | None, int | None]:
    """Blocks that begin with a keyword, see ``hubs.object_sections``."""
    got = hubs.object_sections(p.blocks, p.keywords, p.main)
    return got["containment"], got["description"], got["page"]


def by_class(p: ObjectPages) -> tuple[str | None, str | None, int | None]:
    """The last div of each class (or of one that begins with it) among the grandchildren of a page's content, of the first page that has one; their texts without line ends."""
    found: list[str | None] = [None, None]
    place = None
    for no, h in enumerate(p.html):
        inner = [d for c in content_of(parse(h)).children if isinstance(c, Node) for d in c.children if isinstance(d, Node) and d.tag == "div"]
        before = list(found)
        for k, name in enumerate(p.classes):
            hit = next((d for d in reversed(inner) if d.attrs.get("class", "").startswith(name)), None)
            if found[k] is None and hit is not None:
                found[k] = hit.text().replace("\n", "")
        place = no if found != before else place
        if None not in found:
            break
    return found[0], found[1], place


def by_line(p: ObjectPages) -> tuple[str | None, str | None, int | None]:
    """Lines of the main page: from the first that begins with the containment keyword to the next that begins with the description's; the description's line, with the next one if it is SHORT."""
    lines = [x for b in (p.blocks[p.main] if p.main < len(p.blocks) else []) for x in b.split("\n")]
    held = told = None
    for a, b in p.keywords:
        i = next((i for i, x in enumerate(lines) if x.startswith(a)), None)
        if held is None and i is not None:
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith(b)), len(lines))
            held = "".join(lines[i:end])
        i = next((i for i, x in enumerate(lines) if x.startswith(b)), None)
        if told is None and i is not None:
            told = lines[i] + (lines[i + 1] if len(lines[i]) < SHORT and i + 1 < len(lines) else "")
    return held, told, p.main if held or told else None


Rule = Callable[[ObjectPages], tuple[str | None, str | None, int | None]]
RULES: dict[str, Rule] = {"keyword": by_keyword, "class": by_class, "line": by_line}
FOUND = ["containment", "containment_rule", "description", "description_rule", "page"]
TEXTS = "struct<containment:string,containment_rule:string,description:string,description_rule:string,page:int>"


def extracted(p: ObjectPages, rules: dict[str, Rule]) -> dict:
    """Each text by the first rule that finds it, with the rule's name; ``page`` is that of the first rule that finds any, else the main one."""
    out: dict = {"containment": None, "containment_rule": None, "description": None, "description_rule": None, "page": None}
    for name, rule in rules.items():
        held, told, no = rule(p)
        for what, text in (("containment", held), ("description", told)):
            if out[what] is None and text:
                out[what], out[f"{what}_rule"] = text, name
                out["page"] = no if out["page"] is None else out["page"]
        if out["containment"] is not None and out["description"] is not None:
            break
    out["page"] = p.main if out["page"] is None else out["page"]
    return out


def object_texts(pages: Column, order: tuple[str, ...] = tuple(RULES), keywords: list[tuple[str, str]] = KEYWORDS, classes: tuple[str, str] = CLASSES, main: int = 0) -> Column:
    """A struct TEXTS of an array of an object's pages (HTML): its texts by the rules named in ``order``. Null arrays and pages find nothing."""
    rules = {n: RULES[n] for n in order}

    def texts(s: pd.Series) -> pd.DataFrame:
        out = [extracted(ObjectPages([] if x is None else list(x), main, keywords, classes), rules) for x in s]
        return pd.DataFrame(out, columns=FOUND).astype({"page": "int32"})

    return sliced(pages, texts, TEXTS)


# Canon pages ----------------------------------------------------------------------------------------------------------

# The blocks of canon pages, and tags of addresses that no tag names.
WRAPPER, PANEL = "canon-wrapper", "content-panel centered standalone series"
ADDRESS_TAGS = {"daybreak": "破晓", "lampeter-hub": "兰彼得", "seas-of-orcadia-hub": "orcadia", "simulacrum-project-hub": "幻象计划", "unhuman-hub": "非人类"}
CANON = "array<struct<name:string,address:string,description:string>>"


def canon_blocks(html: str | None, wrapper: str | None = WRAPPER, panel: str = PANEL) -> list[dict]:
    """The canons of a page: elements in divs of class ``wrapper``, or without it divs whose class is ``panel`` as a whole.

    A canon's name is its first h1, else its first h2; the address that heading's first link, without ``.html``; the description its first
    paragraph. What a block lacks is null.
    """
    root = parse(html)
    divs = [n for n in root.walk() if n.tag == "div"]
    found = [c for d in divs if wrapper in d.classes() for c in d.children if isinstance(c, Node)] if wrapper else [d for d in divs if d.attrs.get("class", "") == panel]
    out = []
    for b in found:
        inside = list(b.walk())
        first = lambda tag: next((n for n in inside if n.tag == tag), None)  # noqa: B023, E731
        title, p = first("h1") or first("h2"), first("p")
        link = next((a.attrs["href"] for a in title.walk() if a.tag == "a" and "href" in a.attrs), None) if title else None
        out.append({"name": title.text().strip() if title else None, "address": link.removesuffix(".html") if link else None, "description": p.text().strip() if p else None})
    return out


def canons(pages: DataFrame, html: str, language: str, tags: DataFrame, kind: str, wrapper: str | None = WRAPPER, panel: str = PANEL, overrides: dict[str, str] | None = None, tag: str = "tag", types: str = "type", address: str = "address", pos: str = "pos") -> DataFrame:
    """(name, address, description, language, tag) of the canons of ``pages``: the tag is the one of ``kind`` whose address is the canon's (the last by ``pos``), else that of ``overrides``."""

    @F.pandas_udf(CANON)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([canon_blocks(x, wrapper, panel) for x in s])

    rows = pages.select(F.explode(run(F.col(html))).alias("c")).select("c.*", F.lit(language).alias("language"))
    own = tags.where(F.array_contains(types, kind) & F.col(address).isNotNull())
    return hubs.looked_up(rows, "address", own, address, tag, pos, ADDRESS_TAGS if overrides is None else overrides).select("name", "address", "description", "language", "tag")
