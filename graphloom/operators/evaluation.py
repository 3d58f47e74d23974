"""Scores of extraction output: multiset precision, recall and F1."""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import segment


def counts(gold: DataFrame, predicted: DataFrame, by: list[str], item: str, as_set: bool = False) -> DataFrame:
    """tp, gold, pred of each instance; items count as often as they occur, or once with ``as_set``."""
    if as_set:
        gold, predicted = gold.select(*by, item).distinct(), predicted.select(*by, item).distinct()
    g = gold.groupBy(*by, item).agg(F.count(F.lit(1)).alias("g"))
    p = predicted.groupBy(*by, item).agg(F.count(F.lit(1)).alias("p"))
    j = g.join(p, [*by, item], "full_outer").fillna(0, ["g", "p"])
    return j.groupBy(*by).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum("g").alias("gold"), F.sum("p").alias("pred"))


def totals(c: DataFrame, by: list[str]) -> DataFrame:
    """Sums of ``counts`` (and of ``errors``, where the rows have them) for each group and over all (null group), with P, R and F1 in percent."""
    t = c.rollup(*by).agg(*[F.sum(x).alias(x) for x in ("tp", "gold", "pred", "errors") if x in c.columns])
    from graphloom.functions.text import safe_percent

    t = t.withColumn("precision", safe_percent(F.col("tp"), F.col("pred"))).withColumn("recall", safe_percent(F.col("tp"), F.col("gold")))
    s = F.col("precision") + F.col("recall")
    return t.withColumn("f1", F.when(s == 0, F.lit(0.0)).otherwise(F.round(2 * F.col("precision") * F.col("recall") / F.nullif(s, F.lit(0.0)), 2)))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that is last by ``order`` (aggregated before the shuffle); null orders come first."""
    rest = [c for c in df.columns if c != key]
    last = F.max(F.struct(F.col(order).isNotNull().alias("l_has"), F.col(order).alias("l_order"), *[F.col(c).alias(f"l_{i}") for i, c in enumerate(rest)])).alias("l")
    return df.groupBy(key).agg(last).select(*[F.col(key) if c == key else F.col(f"l.l_{rest.index(c)}").alias(c) for c in df.columns])


def typed_values(output: Column) -> Column:
    """A struct (ok, items) of a model's JSON object of lists by type: items (type, value) in order.

    Text that is no JSON object is not ok and has no items; values that are no text, and types without a list, are passed over. Of repeated keys the last holds.
    """

    @F.pandas_udf("ok boolean, items array<struct<type:string,value:string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            try:
                v = json.loads(x) if x else None
            except ValueError:
                v = None
            ok = isinstance(v, dict)
            out.append({"ok": ok, "items": [{"type": k, "value": y} for k, l in v.items() if isinstance(l, list) for y in l if isinstance(y, str)] if ok else []})
        return pd.DataFrame(out, columns=["ok", "items"])

    return run(output)


def json_object(x: str | None) -> dict | None:
    try:
        v = json.loads(x) if x else None
    except ValueError:
        return None
    return v if isinstance(v, dict) else None


def relations(output: Column) -> Column:
    """A struct (ok, items) of a model's JSON object of lists of pairs by relation: items (head, relation, tail).

    A pair's members are head and tail, or subject and object; a missing one is empty. What is no list, no pair or no text is passed over.
    """

    @F.pandas_udf("ok boolean, items array<struct<head:string,relation:string,tail:string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in map(json_object, s):
            items = []
            for r, pairs in (v or {}).items():
                for p in pairs if isinstance(pairs, list) else ():
                    if isinstance(p, dict):
                        head, tail = p.get("head", p.get("subject", "")), p.get("tail", p.get("object", ""))
                        if isinstance(head, str) and isinstance(tail, str):
                            items.append({"head": head, "relation": r, "tail": tail})
            out.append({"ok": v is not None, "items": items})
        return pd.DataFrame(out, columns=["ok", "items"])

    return run(output)


def events(output: Column, missing: str = "NAN") -> Column:
    """A struct (ok, items) of a model's JSON object of lists of events by type: items (event_type, event_trigger, arguments of (argument, role)).

    An argument is a text or a list of them; those that read ``missing`` go. What has another shape is passed over; an event without a trigger has an empty one.
    """

    @F.pandas_udf("ok boolean, items array<struct<event_type:string,event_trigger:string,arguments:array<struct<argument:string,role:string>>>>")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in map(json_object, s):
            items = []
            for kind, found in (v or {}).items():
                for e in found if isinstance(found, list) else ():
                    trigger = e.get("trigger", "") if isinstance(e, dict) else None
                    if not isinstance(trigger, str):
                        continue
                    roles = e.get("arguments", {})
                    told = [(r, x) for r, a in roles.items() for x in (a if isinstance(a, list) else [a])] if isinstance(roles, dict) else []
                    items.append({"event_type": kind, "event_trigger": trigger, "arguments": [{"argument": x, "role": r} for r, x in told if isinstance(x, str) and x != missing]})
            out.append({"ok": v is not None, "items": items})
        return pd.DataFrame(out, columns=["ok", "items"])

    return run(output)


def attribute_relations(output: Column) -> Column:
    """A struct (ok, items) of a model's JSON {type: {head: {relation: tail or list}}}: items (head, relation, tail), as gold records have them."""

    @F.pandas_udf("ok boolean, items array<struct<head:string,relation:string,tail:string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in map(json_object, s):
            heads = [(h, a) for t in (v or {}).values() if isinstance(t, dict) for h, a in t.items() if isinstance(a, dict)]
            items = [{"head": h, "relation": r, "tail": x} for h, a in heads for r, y in a.items() for x in (y if isinstance(y, list) else [y]) if isinstance(x, str)]
            out.append({"ok": v is not None, "items": items})
        return pd.DataFrame(out, columns=["ok", "items"])

    return run(output)


def reader(task: str):
    """The function that reads a task's output; tasks that have none raise an error."""
    readers = {"NER": typed_values, "EET": typed_values, "RE": relations, "SPO": relations, "EE": events, "EEA": events, "KG": attribute_relations}
    if task not in readers:
        raise ValueError(f"no reader of {task}; there are {', '.join(sorted(readers))}")
    return readers[task]


def event_scores(gold: DataFrame, predicted: DataFrame, by: list[str], events_column: str, as_set: bool = False) -> DataFrame:
    """(level, tp, gold, pred) of each instance: of events by (type, trigger), and of arguments by (type, argument, role)."""
    out = None
    for level, k in (("event", 0), ("argument", 1)):
        items = lambda d: d.select(*by, F.explode(event_items(F.col(events_column))[k]).alias("item"))  # noqa: B023, E731
        c = counts(items(gold), items(predicted), by, "item", as_set).withColumn("level", F.lit(level))
        out = c if out is None else out.unionByName(c)
    return out


def joined_chunks(rows: DataFrame, by: list[str], pos: str, items: str, label: str) -> DataFrame:
    """The chunks of each instance as one: items in the order of ``pos``, the label of the first."""
    s = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(items).alias("i"))))
    return rows.groupBy(*by).agg(F.flatten(F.transform(s, lambda x: x["i"])).alias(items), F.min_by(label, pos).alias(label))


def event_items(events: Column) -> tuple[Column, Column]:
    """The items that events (event_type, event_trigger, arguments) are scored by: (type, trigger), and (type, argument, role)."""
    whole = F.transform(events, lambda e: F.struct(e["event_type"].alias("type"), e["event_trigger"].alias("trigger")))
    parts = F.flatten(F.transform(events, lambda e: F.transform(e["arguments"], lambda a: F.struct(e["event_type"].alias("type"), a["argument"].alias("argument"), a["role"].alias("role")))))
    return whole, parts


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a bit for each token of ``a``, a sum of integers for each of ``b``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every  # a zero is a step of the subsequence
    for y in b:
        same = row & places.get(y, 0)
        row = ((row + same) | (row - same)) & every
    return len(a) - row.bit_count()


def overlap(a: list[str], b: list[str], n: int) -> float:
    """F1 of the n-grams of two lists, each counted as often as both hold it; 0 where one has none."""
    x, y = (Counter(zip(*(t[i:] for i in range(n)))) for t in (a, b))
    same = (x & y).total()
    return 2 * same / (x.total() + y.total()) if same else 0.0


def longest(a: list[str], b: list[str]) -> float:
    """F1 of the longest common subsequence of two lists."""
    n = lcs(a, b)
    return 2 * n / (len(a) + len(b)) if n else 0.0


def pairwise(score, reference: Column, candidate: Column) -> Column:
    """``score`` of two columns, of lists of tokens or of texts cut at white space. Null counts as empty."""

    @F.pandas_udf("double")
    def run(r: pd.Series, c: pd.Series) -> pd.Series:
        tokens = lambda x: x.split() if isinstance(x, str) else [] if x is None else list(x)
        return pd.Series([score(tokens(x), tokens(y)) for x, y in zip(r, c)], dtype="float64")

    return run(reference, candidate)


def rouge_l(reference: Column, candidate: Column) -> Column:
    """F1 of the longest common subsequence of the tokens of two texts, or of two arrays of tokens."""
    return pairwise(longest, reference, candidate)


def rouge_n(reference: Column, candidate: Column, n: int) -> Column:
    """F1 of the n-grams of the tokens of two texts, or of two arrays of tokens."""
    return pairwise(lambda a, b: overlap(a, b, n), reference, candidate)


def rouge(reference: Column, candidate: Column, counts: dict[str, int] | None = None) -> Column:
    """A struct (rouge_1, rouge_2, rouge_l) of two texts in percent; with a frequency table ``counts`` their words are those of the likeliest path (see ``functions.segment``), else they are cut at white space."""
    r, c = (reference, candidate) if counts is None else (segment.words(reference, counts), segment.words(candidate, counts))
    told = {"rouge_1": rouge_n(r, c, 1), "rouge_2": rouge_n(r, c, 2), "rouge_l": rouge_l(r, c)}
    return F.struct(*[F.round(v * 100, 4).alias(k) for k, v in told.items()])


def merged_counts(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Counts of several runs as one: tp, gold and pred add up."""
    from functools import reduce

    both = reduce(lambda a, b: a.unionByName(b), [p.select(*by, "tp", "gold", "pred") for p in parts])
    return both.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("tp", "gold", "pred")])


def attribute_triples(entities: Column) -> Column:
    """(head, relation, tail) of a map by head of maps by relation of tails."""
    pairs = lambda e: F.flatten(F.transform(F.map_entries(e["value"]), lambda r: F.transform(r["value"], lambda t: F.struct(e["key"].alias("head"), r["key"].alias("relation"), t.alias("tail")))))
    return F.flatten(F.transform(F.map_entries(entities), pairs))


def missed(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """One row: n, the gold instances, and missing, those without a prediction."""
    p = predicted.select(F.col(key).alias("m_key")).distinct()
    return gold.join(p, F.col(key) == F.col("m_key"), "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m_key").isNull()).alias("missing"))


def with_errors(c: DataFrame, outputs: DataFrame, by: list[str], ok: str = "ok") -> DataFrame:
    """``counts`` with ``errors``, how many of an instance's ``outputs`` could not be read (``ok`` is false or null); instances without items count 0."""
    e = outputs.groupBy(*by).agg(F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("errors"))
    return c.join(e, by, "full_outer").fillna(0, ["tp", "gold", "pred", "errors"])
