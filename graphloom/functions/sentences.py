"""Sentence splitting that respects open quotes (Arrow-batched)."""

from __future__ import annotations

import pandas as pd

from graphloom.functions.slices import sliced

ENDS = "。！？"
# Opening and closing quotes by pair. The ASCII quote opens.
QUOTES = {"“": "”", "「": "」", "[": "]", "【": "】", "{": "}", "‘": "’", "<": ">", "《": "》", "(": ")", "（": "）", '"': '"'}


def sentences(paragraph: str | None, ends: str = ENDS) -> list[str]:
    """Each line cut after a terminator where no quote is open and no terminator follows; a lone closing quote joins the sentence before.

    A closing quote ends the first open one of its kind. An ASCII quote closes one that is open, else it opens.
    """
    out: list[str] = []
    closing = set(QUOTES.values())
    for line in (paragraph or "").split("\n"):
        line = line.strip()
        if not line:
            continue
        start, open_ = 0, []
        mine: list[str] = []
        for i, ch in enumerate(line):
            if ch in open_:
                open_.remove(ch)
            elif ch in QUOTES:
                open_.append(QUOTES[ch])
            if ch in ends and not open_ and (i + 1 == len(line) or line[i + 1] not in ends):
                mine.append(line[start : i + 1])
                start = i + 1
        rest = line[start:]
        if rest and rest in closing and mine:
            mine[-1] += rest
        elif rest:
            mine.append(rest)
        out.extend(s.strip() for s in mine if s.strip())
    return out


def split_sentences(column, ends: str = ENDS):
    return sliced(column, lambda s: pd.Series([sentences(x, ends) for x in s]), "array<string>")
