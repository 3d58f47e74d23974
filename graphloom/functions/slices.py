"""Arrow-batched functions that answer a batch in slices, so that what they make of long texts never piles up for a whole batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that a slice takes before it ends, and the most rows of one.
CHARACTERS, ROWS = 1 << 20, 256


def slices(s: pd.Series, weight: Callable[[object], int], characters: int = CHARACTERS, rows: int = ROWS) -> Iterator[pd.Series]:
    """Consecutive slices of ``rows`` rows at most, each ending with the row that brings it to ``characters``; an empty series is one slice."""
    start = size = 0
    for i, x in enumerate(s):
        size += weight(x)
        if size >= characters or i + 1 - start == rows:
            yield s.iloc[start : i + 1]
            start, size = i + 1, 0
    if start < len(s) or not len(s):
        yield s.iloc[start:]


def characters(x) -> int:
    """Those of a text, or of an array of texts; null has none."""
    return 0 if x is None else len(x) if isinstance(x, str) else sum(len(y) for y in x if y is not None)


def sliced(column: Column, f: Callable[[pd.Series], pd.Series | pd.DataFrame], schema: str) -> Column:
    """``f`` of a column of texts or of arrays of texts, slice by slice."""

    def run(batches):
        for s in batches:
            for part in slices(s, characters):
                yield f(part)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame if schema.lstrip().startswith("struct<") else pd.Series]}
    return F.pandas_udf(run, schema)(column)
