"""All places of many terms in texts, in one pass of a text: an automaton of the terms (Arrow batches)."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that a task's automaton holds at most.
HELD = 1 << 18


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def term_offsets(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, held: int = HELD) -> DataFrame:
    """(key, term, offset): every occurrence of every term, also those that overlap or lie within one another; offsets count code points from 0.

    Terms count once however often ``terms`` has them; null terms have no occurrence, an empty one stands before each character and at the end. Null texts have none. Up to
    ``held`` terms make one automaton, which each task builds; more are dealt to several by hash, each a pass of the texts.
    """
    wanted = terms.select(F.col(term).alias("t")).where("t is not null").distinct()
    shards = max(1, -(-2 * wanted.count() // held)) if wanted.count() > held else 1
    rows = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    kind = texts.schema[key].dataType.simpleString()
    out = None
    for i in range(shards):
        own = wanted if shards == 1 else wanted.where(F.pmod(F.xxhash64("t"), F.lit(shards)) == i)
        found = rows.mapInArrow(scanner(sorted(r["t"] for r in own.collect())), f"k {kind}, term string, offset long")  # ``held`` terms at most
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("k").alias(key), F.col("term").alias("term"), "offset")


def scanner(terms: list[str]):
    """The function of a task's batches (key, text) for these terms."""
    every, some = "" in terms, [t for t in terms if t]

    def run(batches):
        a = automaton(some) if some else None
        for b in batches:
            row, term, offset = [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                for end, t in a.iter(x) if a is not None else ():
                    row.append(i)
                    term.append(t)
                    offset.append(end - len(t) + 1)
                if every:
                    row += [i] * (len(x) + 1)
                    term += [""] * (len(x) + 1)
                    offset += range(len(x) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(term, pa.string()), pa.array(offset, pa.int64())], names=["k", "term", "offset"])

    return run


def all_offsets(text: Column, term: Column) -> Column:
    """The offsets of one term in one text, in order; an empty term stands before each character and at the end. Null if either is."""
    most = F.length(text) - F.length(term)
    at = F.when(most >= 0, F.sequence(F.lit(0), most)).when(most < 0, F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.substr(text, i + 1, F.length(term)) == term)
