"""A hub page as its ordered items: headings, paragraphs, list items, table rows, rules and marked elements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.html import Node, parse, selector, without

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li tr hr dt dd".split())
ITEM = "array<struct<pos:int,tab:int,tab_no:int,tag:string,cls:string,text:string,links:array<struct<href:string,text:string>>,cells:array<string>>>"


def page_items(html: str | None, content_id: str = "page-content", marks: frozenset[str] = frozenset(), tab_class: str = "tab", removed: tuple[str, ...] = ("script", "style")) -> list[dict]:
    """Items in document order. ``tab`` counts the divs of ``tab_class`` begun so far (0: before any), ``tab_no`` the tables.

    Elements with a class in ``marks`` are items of their own, without a text. A list item's text ends where a list within it
    starts, whose items follow. Null and empty pages have no items.
    """
    root = parse(html)
    content = next((n for n in root.walk() if n.tag == "div" and n.attrs.get("id") == content_id), None) or next((n for n in root.walk() if n.tag == "body"), root)
    without(content, [selector(s) for s in removed])
    out: list[dict] = []
    tab = tables = 0
    todo: list = list(reversed(content.children))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            continue
        marked = next((c for c in n.classes() if c in marks), None)
        if n.tag == "div" and tab_class in n.classes():
            tab += 1
        if n.tag == "table":
            tables += 1
        if marked is None and n.tag not in LEAVES:
            todo.extend(reversed(n.children))
            continue
        inner = [] if marked is not None else [c for c in n.children if isinstance(c, Node) and n.tag == "li" and c.tag in ("ul", "ol")]
        own = Node(n.tag, n.attrs)
        own.children = [c for c in n.children if not any(c is x for x in inner)]
        out.append(
            {
                "pos": len(out), "tab": tab, "tab_no": tables, "tag": n.tag, "cls": marked,
                "text": "" if marked is not None else own.text().strip(),
                "links": [{"href": a.attrs.get("href", ""), "text": a.text().strip()} for a in own.walk() if a.tag == "a"],
                "cells": [c.text().strip() for c in own.children if isinstance(c, Node) and c.tag in ("td", "th")],
            }
        )
        todo.extend(reversed(inner))
    return out


def items(pages: DataFrame, key: str, html: str, **options) -> DataFrame:
    """(key, pos, tab, tab_no, tag, cls, text, links, cells): a row for each item of each page."""

    @F.pandas_udf(ITEM)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([page_items(x, **options) for x in s])

    return pages.select(F.col(key), F.explode(run(F.col(html))).alias("i")).select(key, "i.*")
