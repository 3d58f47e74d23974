"""Text formats of labels, schemas inferred from data, placeholders and a random order of types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "NAN"


def schema_of(records: DataFrame, labels: str, kind: str) -> DataFrame:
    """One row: the distinct types of all labels, sorted."""
    return records.select(F.explode(labels).alias("l")).agg(F.array_sort(F.collect_set(F.col("l")[kind])).alias("types"))


def roles_by_type(records: DataFrame, events: str, kind: str, arguments: str, role: str) -> DataFrame:
    """(type, roles): the roles that arguments of each event type have."""
    e = records.select(F.explode(events).alias("e")).select(F.col("e")[kind].alias("type"), F.explode_outer(F.col("e")[arguments]).alias("a"))
    return e.groupBy("type").agg(F.array_sort(F.collect_set(F.col("a")[role])).alias("roles"))


def with_placeholders(labels: Column, negatives: Column, value: str, kind: str) -> Column:
    """The labels and, for each negative type, one with an empty value."""
    own = F.transform(labels, lambda l: F.struct(l[value].alias(value), l[kind].alias(kind)))
    return F.concat(own, F.transform(negatives, lambda t: F.struct(F.lit("").alias(value), t.alias(kind))))


def random_order(labels: Column, text: Column, value: str, kind: str, seed: int = 2024) -> Column:
    """Labels by a hash of their type, then by where the value first stands in the text (-100: nowhere, or empty)."""
    at = lambda l: F.when((l[value] == "") | ~F.contains(text, l[value]), F.lit(-100)).otherwise(F.instr(text, l[value]) - 1)
    keyed = F.transform(labels, lambda l: F.struct(F.xxhash64(F.lit(seed), l[kind]).alias("h"), at(l).alias("at"), l.alias("l")))
    return F.transform(F.array_sort(keyed), lambda s: s["l"])


def tuples(labels: Column, *fields: str) -> Column:
    """``(a,b,c)`` lines of the labels whose first field is not empty; without any, NAN."""
    some = F.filter(labels, lambda l: l[fields[0]] != "")
    lines = F.transform(some, lambda l: F.concat(F.lit("("), F.concat_ws(",", *[l[f] for f in fields]), F.lit(")")))
    return F.when(F.size(some) == 0, F.lit(EMPTY)).otherwise(F.array_join(lines, "\n"))


def untupled(text: Column, n: int) -> Column:
    """The fields of ``(a,b,c)`` lines, an array of arrays; lines of another number of fields go. NAN and null: empty."""
    inner = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^\((.*)\)$"), F.lit(1))
    return F.filter(F.transform(inner, lambda x: F.split(x, ",")), lambda p: F.size(p) == n)
