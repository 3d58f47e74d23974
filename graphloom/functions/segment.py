"""Words of texts without spaces: the likeliest path through the lattice of all words that a frequency table has."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a task's table holds at most.
HELD = 1 << 20
#: A run of other letters and digits is a word, whatever the table has, and so is each other character.
PIECES = re.compile(r"[㐀-䶿一-鿿豈-﫿]+|[A-Za-z0-9]+(?:[.%+#&_-][A-Za-z0-9]+)*|\S")


class Words:
    """The table's words with the logarithms of their shares, and all their beginnings, so that a lattice stops where no word goes on."""

    def __init__(self, counts: dict[str, int]):
        counts = {w: n for w, n in counts.items() if w and n > 0}
        self.total = math.log(sum(counts.values()) or 1)
        self.share = {w: math.log(n) - self.total for w, n in counts.items()}
        self.begins = {w[:i] for w in counts for i in range(1, len(w))}

    def best(self, run: str) -> list[str]:
        """The words of the likeliest path; of equally likely ones that with the longest first word. A character that no word holds counts once."""
        n = len(run)
        score, to = [0.0] * (n + 1), [0] * n
        for i in reversed(range(n)):
            score[i], to[i] = self.share.get(run[i], -self.total) + score[i + 1], i + 1
            j = i + 1
            while j < n and run[i:j] in self.begins:
                j += 1
                s = self.share.get(run[i:j])
                if s is not None and s + score[j] >= score[i] - 1e-12:
                    score[i], to[i] = s + score[j], j
        out, i = [], 0
        while i < n:
            out.append(run[i : to[i]])
            i = to[i]
        return out

    def __call__(self, text: str) -> list[str]:
        out = []
        for m in PIECES.finditer(text):
            x = m[0]
            out += self.best(x) if len(x) > 1 and x[0] > "㏿" else [x]
        return out


def table_of(counts: DataFrame, word: str, n: str, held: int = HELD) -> dict[str, int]:
    """A frequency table as the segmenter takes it; of more than ``held`` words the most frequent, ties by the word."""
    rows = counts.select(F.col(word).alias("w"), F.col(n).cast("long").alias("n")).where("w is not null and n > 0").orderBy(F.desc("n"), "w").limit(held)
    return {r["w"]: r["n"] for r in rows.collect()}


def words(text: Column, counts: dict[str, int]) -> Column:
    """The words of a text, white space left out; null: null."""
    return F.when(text.isNotNull(), _words(text, counts))


def _words(text: Column, counts: dict[str, int]) -> Column:
    held: list[Words] = []

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        if not held:
            held.append(Words(counts))  # once a task
        return s.map(lambda x: held[0](x or ""))

    return run(text)
