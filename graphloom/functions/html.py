"""HTML pages as blocks, links and text: a tolerant tree builder behind one Arrow-batched function.

A null or empty page gives empty lists and an empty text. Unclosed elements end where their parent ends or where
the next element implies it; end tags without a start are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

import ahocorasick
import pandas as pd
from pyspark.sql import Column

from graphloom.functions.slices import sliced

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element on the left ends when one on the right starts in it.
IMPLIED = {"p": frozenset("p div ul ol table blockquote h1 h2 h3 h4 h5 h6 hr section".split()), "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

# Nodes that hold no content, how a block starts, and what is a whole block.
REMOVED = [
    'div[style="display: none"]', 'div[style="display: none;"]', "div.code", "div.pseudocrumbs", "div.adytoc", "div#u-credit-view", "div.page-rate-widget-box",
    "div.creditRate", "div.licensebox", "div.info-container", "div.footer-wikiwalk-nav", "div.footnotes-footer", "script", "div.scp-image-block",
    "div.scp-image-caption", "div.image-box", "span.fnnum", "span.footnoteref", "sup.footnoteref", "span.fncon", "span.lang-tr", "style", "div#counter",
    'span[style="text-decoration: line-through;"]', 'span[style="text-decoration: line-through"]',
]
BLOCK_START = ["<hr>", "<p><strong>", "<p><b>", "<strong>", "<h1>", "<h2>", "<h3>", "<h4>"]
BLOCK_CLOSE = ["<div class=", "<table", "<blockquote>", "<div style="]

PAGE = "struct<tags:array<string>,links:array<struct<link:string,text:string>>,blocks:array<string>,text:string>"


class Node:
    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; without recursion, as pages may nest deeply."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "br":
                out.append("\n")
            else:
                todo.extend(reversed(n.children))
        return "".join(out)

    def head(self, most: int = 2) -> str:
        """The start tags that the node's HTML begins with."""
        out, n = "", self
        for _ in range(most):
            out += "<" + n.tag + "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items()) + ">"
            if not n.children or not isinstance(n.children[0], Node):
                break
            n = n.children[0]
        return out


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and tag in IMPLIED.get(self.open[-1].tag, ()):
            self.open.pop()
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = Builder()
    b.feed(html or "")
    b.close()
    return b.root


def selector(css: str) -> Callable[[Node], bool]:
    """A test for ``tag``, ``tag.class``, ``tag#id`` or ``tag[attribute="value"]``."""
    m = re.fullmatch(r'(\w+)(?:\.([\w-]+)|#([\w-]+)|\[(\w+)="([^"]*)"\])?', css)
    if not m:
        raise ValueError(f"no such selector: {css}")
    tag, cls, ident, name, value = m.groups()
    test = lambda n: n.tag == tag and (cls is None or cls in n.classes()) and (ident is None or n.attrs.get("id") == ident) and (name is None or n.attrs.get(name) == value)
    test.tag = tag
    return test


def without(root: Node, tests: list[Callable[[Node], bool]]) -> Node:
    """The tree without the nodes that pass a test of ``selector`` (in place). A node meets the tests of its tag alone."""
    of: dict[str, list] = {}
    for t in tests:
        of.setdefault(t.tag, []).append(t)
    for n in [root, *root.walk()]:
        if any(not isinstance(c, str) and c.tag in of for c in n.children):
            n.children = [c for c in n.children if isinstance(c, str) or not any(t(c) for t in of.get(c.tag, ()))]
    return root


GONE = [selector(s) for s in REMOVED]


def bordered(root: Node) -> set[str]:
    """Selectors of this page's style rules with a border; ``.alt-block`` where there is none."""
    out = set()
    for n in root.walk():
        if n.tag == "style":
            for names, body in re.findall(r"([^{}]+)\{([^}]*)\}", n.text()):
                if any(v.strip() not in ("0", "none") for v in re.findall(r"border\s*:([^;]*)", body)):
                    out.update(x for x in re.split(r"(?<![~+>]) (?![~+>])", names.strip().replace(",", "")) if x)
    return out or {".alt-block"}


def unfolded(node: Node, stop: set[str]) -> list:
    """Children with plain divs opened up, in order; divs of a stopping class or a border stay whole. A collapsible div gives its first content."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str) or c.tag != "div":
            out.append(c)
        elif "colmod-block" in c.classes():
            inner = next((n for n in c.walk() if n.tag == "div" and "colmod-content" in n.classes()), c)
            todo.extend(reversed(inner.children))
        elif "." + c.attrs.get("class", "") in stop or "border" in c.attrs.get("style", ""):
            out.append(c)
        else:
            todo.extend(reversed(c.children))
    return out


def row_text(row: Node) -> str:
    cells = [re.sub(r"\s*\n\s*", "; ", n.text().strip()) for n in row.walk() if n.tag in ("td", "th")]
    return "【" + "|".join(cells) + "】"


def node_text(n) -> str:
    if isinstance(n, str):
        return n
    rows = [r for r in [n, *n.walk()] if r.tag == "tr"]
    return "\n".join(map(row_text, rows)) if rows else n.text()


def once(whole: str, texts: set[str]) -> set[str]:
    """Those of ``texts`` that stand in ``whole`` exactly once, by one pass over it."""
    a = ahocorasick.Automaton()
    for t in texts:
        a.add_word(t, t)
    a.make_automaton()
    n: dict[str, int] = {}
    last: dict[str, int] = {}
    for end, t in a.iter(whole):
        if end - len(t) >= last.get(t, -1):  # occurrences of one text that overlap count once
            n[t], last[t] = n.get(t, 0) + 1, end
    return {t for t, k in n.items() if k == 1}


def wrapped(content: Node) -> Node:
    """Bare texts of the content that stand in it once as paragraphs of their own (in place); texts that recur stay bare."""
    bare = {c.strip() for c in content.children if isinstance(c, str) and c.strip()}
    alone = once(content.text(), bare) if bare else bare
    for i, c in enumerate(content.children):
        if isinstance(c, str) and c.strip() in alone:
            p = Node("p", {})
            p.children = [c]
            content.children[i] = p
    return content


def blocks(content: Node, stop: set[str]) -> list[str]:
    """Texts of the blocks: a heading opens one, tables and framed divs are one each, others join the last.

    A block that is but a colon takes in the next.
    """
    parts: list[list[str]] = []
    closed = True
    for n in unfolded(content, stop):
        if isinstance(n, str) and not n.strip():
            continue
        head = "" if isinstance(n, str) else n.head()
        whole = any(head.startswith(x) for x in BLOCK_CLOSE)
        if closed or whole or any(head.startswith(x) for x in BLOCK_START):
            parts.append([])
        parts[-1].append(node_text(n))
        closed = whole
    out: list[str] = []
    for p in parts:
        t = re.sub(r"\s*\n+\s*", "\n", "\n".join(p).strip())
        if not t:
            continue
        if out and re.fullmatch(r"[:：]", out[-1]):
            out[-1] += t
        else:
            out.append(t)
    return out


def content_of(root: Node, content_id: str = "page-content") -> Node:
    """The div of ``content_id``; where there is none, the body or all."""
    return next((n for n in [root, *root.walk()] if n.tag == "div" and n.attrs.get("id") == content_id), None) or next((n for n in [root, *root.walk()] if n.tag == "body"), root)


def links_of(content: Node, suffix: str, excluded: frozenset[str]) -> list[dict]:
    """Links of nested anchors whose address ends in ``suffix``, the last first."""
    direct = {id(c) for c in content.children}
    links = [{"link": a.attrs["href"].removesuffix(suffix), "text": a.text()} for a in content.walk() if a.tag == "a" and id(a) not in direct and a.attrs.get("href", "").endswith(suffix) and a.attrs["href"] not in excluded]
    return links[::-1]


def page(html: str | None, content_id: str = "page-content", suffix: str = ".html", excluded: frozenset[str] = frozenset()) -> dict:
    """tags, links (last first, of nested anchors whose address ends in ``suffix``), blocks and text of a page.

    The content is the div of ``content_id``; where there is none, the body or all.
    """
    root = parse(html)
    tags = sorted({a.text() for d in root.walk() if d.tag == "div" and "page-tags" in d.classes() for s in d.children if isinstance(s, Node) and s.tag == "span" for a in s.children if isinstance(a, Node) and a.tag == "a"})
    stop = bordered(root)
    content = without(content_of(root, content_id), GONE)
    return {"tags": tags, "links": links_of(content, suffix, excluded), "blocks": blocks(wrapped(content), stop), "text": content.text().strip()}


def page_blocks(html: str | None, content_id: str = "page-content") -> list[str]:
    """The ``blocks`` of ``page`` alone."""
    root = parse(html)
    stop = bordered(root)
    return blocks(wrapped(without(content_of(root, content_id), GONE)), stop)


def linked(column: Column, content_id: str = "page-content", suffix: str = ".html", excluded: frozenset[str] = frozenset()) -> Column:
    """The ``links`` of ``page`` alone: no blocks are cut for them."""

    return sliced(column, lambda s: pd.Series([links_of(without(content_of(parse(x), content_id), GONE), suffix, excluded) for x in s]), "array<struct<link:string,text:string>>")


def selected(column: Column, css: str, written: bool = False) -> Column:
    """An array of structs (text, href) of the elements that a simple selector names, in order: the stripped text, and the address of the first link at or below it (null without one).

    With ``written`` both are as the page has them: character references stay as they are.
    """
    test = selector(css)

    def told(n: Node, mark: str | None) -> dict:
        href = next((a.attrs["href"] for a in [n, *n.walk()] if a.tag == "a" and "href" in a.attrs), None)
        text = n.text().strip()
        return {"text": text.replace(mark, "&"), "href": href and href.replace(mark, "&")} if mark else {"text": text, "href": href}

    def found(x: str | None) -> list[dict]:
        mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in x) if written and x else None  # a sign that isn't in the page stands for the ampersand
        return [told(n, mark) for n in parse(x.replace("&", mark) if mark else x).walk() if test(n)]

    return sliced(column, lambda s: pd.Series([found(x) for x in s]), "array<struct<text:string,href:string>>")


def parsed(column: Column, content_id: str = "page-content", suffix: str = ".html", excluded: frozenset[str] = frozenset()) -> Column:
    """``page`` as a struct column."""

    return sliced(column, lambda s: pd.DataFrame([page(x, content_id, suffix, excluded) for x in s], columns=["tags", "links", "blocks", "text"]), PAGE)
