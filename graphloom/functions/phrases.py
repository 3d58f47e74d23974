"""Conversion of texts by a table of phrases: at each place the longest phrase that stands there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

END = ""


class Trie:
    """Phrases by their characters; a node is a dictionary, and holds the phrase's value under END."""

    def __init__(self, table: dict[str, str]):
        self.root: dict = {}
        for phrase, value in table.items():
            if phrase:
                node = self.root
                for c in phrase:
                    node = node.setdefault(c, {})
                node[END] = value

    def longest(self, text: str, start: int) -> tuple[int, str | None]:
        """(the place after it, its value) of the longest phrase at ``start``; without one the next place and None."""
        node, found, i = self.root, (start + 1, None), start
        while i < len(text) and (node := node.get(text[i])) is not None:
            i += 1
            if END in node:
                found = i, node[END]
        return found

    def converted(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            j, value = self.longest(text, i)
            out.append(text[i:j] if value is None else value)
            i = j
        return "".join(out)


def converted(c: Column, *tables: dict[str, str]) -> Column:
    """The text with its phrases converted, by one table after the other (of which each reads what the one before gave): characters that no phrase holds stay. Null stays null."""
    held: list[Trie] = []

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        if not held:
            held.extend(Trie(t) for t in tables)  # once a task

        def one(x: str | None) -> str | None:
            for t in held if x else ():
                x = t.converted(x)
            return x

        return s.map(one, na_action="ignore")

    return run(c)
