"""Annotated records to instruction rows in the older form: a template, a text format and placeholders for absent types, drawn by record.

Every draw is a hash of the text and a seed, so that a row comes out alike whatever the partitions are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import formats as L
from graphloom.operators import instructions as I
from graphloom.operators.conversion import LABELS, Schema, texts
from graphloom.operators.legacy import roles_by_type, schema_of
from graphloom.sources import files

# How an instruction shows each text format, by kind and language.
SHOWN = {
    ("entity", "zh"): ("(实体,实体类型)\n", "实体是,实体类型是\n", "实体类型：实体\n", "{'entity':'', 'entity_type':''}\n"),
    ("entity", "en"): ("(Entity,Entity Type)\n", "Entity is,Entity Type is\n", "Entity Type：Entity\n", "{'entity':'', 'entity_type':''}\n"),
    ("relation", "zh"): ("(头实体,关系,尾实体)\n", "头实体是,关系是,尾实体是\n", "关系：头实体,尾实体\n", "{'head':'', 'relation':'', 'tail':''}\n"),
    ("relation", "en"): ("(Subject,Relation,Object)\n", "Subject is,Relation is,Object is\n", "Relation：Subject,Object\n", "{'head':'', 'relation':'', 'tail':''}\n"),
    ("trigger", "zh"): ("(事件触发词,事件类型)\n", "事件触发词是,事件类型是\n", "事件类型：事件触发词\n", "{'event_trigger':'', 'event_type':''}\n"),
    ("trigger", "en"): ("(Event Trigger,Event Type)\n", "Event Trigger is,Event Type is\n", "Event Type：Event Trigger\n", "{'event_trigger':'', 'event_type':''}\n"),
    ("event", "zh"): ("(事件触发词,事件类型,事件论元1#论元角色1;事件论元2#论元角色2)\n", "事件触发词是,事件类型是\n事件论元1是,论元角色1是;事件论元2是,论元角色2是\n\n", "事件类型：事件触发词\n论元角色1：事件论元1;论元角色2：事件论元2\n\n", "{'event_trigger':'', 'event_type':'', 'arguments':({'argument':'', 'role':''},)}\n"),
    ("event", "en"): ("(Event Trigger,Event Type,Argument1#Argument Role1;Argument2#Argument Role2)\n", "Event Trigger is,Event Type is\nArgument1 is,Argument Role1 is;Argument2 is,Argument Role2 is\n\n", "Event Type：Event Trigger\nArgument Role1：Argument1;Argument Role2：Argument2\n\n", "{'event_trigger':'', 'event_type':'', 'arguments':({'argument':'', 'role':''},)}\n"),
}


@dataclass(frozen=True)
class Task:
    """The column of a task's labels, the kind in which they are written, the field of a label's name, and where a schema has the names."""

    labels: str
    kind: str
    name: str
    names: str


TASKS = {
    "NER": Task("entity", "entity", "entity_type", "types"),
    "RE": Task("relation", "relation", "relation", "roles"),
    "EE": Task("event", "event", "event_type", "types"),
    "EET": Task("event", "trigger", "event_type", "types"),
    "EEA": Task("event", "event", "event_type", "types"),
}


def inferred(records: DataFrame, task: str) -> Schema:
    """The schema that the labels of a task have, sorted: types, roles, and the roles of each event type."""
    t = TASKS[task]
    names = tuple(schema_of(records, t.labels, t.name).first()["types"] or ())
    if task != "EE":
        return Schema(types=names) if t.names == "types" else Schema(roles=names)
    by = sorted((r["type"], tuple(r["roles"])) for r in roles_by_type(records, "event", "event_type", "arguments", "role").collect())  # a row a type
    return Schema(names, tuple(sorted({x for _, r in by for x in r})), tuple(by))


def drawn(items: Column, n: Column | int, *key: Column) -> Column:
    """``n`` of the items in an order by hash."""
    order = F.array_sort(F.transform(items, lambda x: F.struct(F.xxhash64(*key, x).alias("h"), x.alias("x"))))
    return F.slice(F.transform(order, lambda s: s["x"]), 1, n if isinstance(n, int) else n.cast("int"))


def placeholder(task: Task, name: Column, labels: Column, roles: Column | None = None) -> Column:
    """A label of the name alone, its other fields empty; ``labels`` tells the fields' order."""
    empty = F.lit("")
    if task.labels == "entity":
        return F.struct(empty.alias("entity"), name.alias("entity_type"))
    if task.labels == "relation":
        return F.struct(empty.alias("head"), name.alias("relation"), empty.alias("tail"))
    arguments = F.transform(roles, lambda r: F.struct(empty.alias("argument"), r.alias("role")))
    return F.struct(empty.alias("event_trigger"), name.alias("event_type"), arguments.alias("arguments"))


def plain(task: Task, labels: Column) -> Column:
    """Labels with the fields that are written, in one order, so that placeholders can join them."""
    none = F.array().cast("array<struct<argument:string,role:string>>")
    fields = {"entity": ("entity", "entity_type"), "relation": ("head", "relation", "tail")}
    if task.labels in fields:
        return F.transform(labels, lambda l: F.struct(*[F.coalesce(l[f], F.lit("")).alias(f) for f in fields[task.labels]]))
    arguments = lambda l: F.transform(F.coalesce(l["arguments"], none), lambda a: F.struct(F.coalesce(a["argument"], F.lit("")).alias("argument"), a["role"].alias("role")))
    return F.transform(labels, lambda l: F.struct(F.coalesce(l["event_trigger"], F.lit("")).alias("event_trigger"), l["event_type"].alias("event_type"), arguments(l).alias("arguments")))


def with_negatives(task: str, labels: Column, schema: Schema, n: int, key: Column, seed: int) -> Column:
    """``labels`` and placeholders: of ``n`` names drawn from the whole schema (all, if ``n`` < 1) those that no label has.

    For EE, an event whose type has roles that none of its events has gets placeholders of one to ``n`` drawn roles of the type, but for those an event before it has;
    drawn types come with all their roles. EEA has no placeholders.
    """
    t = TASKS[task]
    if task == "EEA":
        return labels
    every = schema.types if t.names == "types" else schema.roles
    names = texts(sorted(set(every)))
    held = F.transform(labels, lambda l: l[t.name])
    chosen = F.array_except(drawn(names, len(every) if n < 1 else n, key, F.lit(seed)), held)
    roles_of = F.map_from_entries(F.array(*[F.struct(F.lit(k), texts(v)) for k, v in schema.type_roles])) if schema.type_roles else F.lit(None).cast("map<string,array<string>>")
    roles = lambda x: F.coalesce(F.try_element_at(roles_of, x), texts(()))
    negatives = F.transform(chosen, lambda x: placeholder(t, x, labels, roles(x) if task == "EE" else texts(())))
    if task != "EE":
        return F.concat(labels, negatives)
    has = lambda x: F.flatten(F.transform(F.filter(labels, lambda e: e["event_type"] == x), lambda e: F.transform(e["arguments"], lambda a: a["role"])))

    def of_event(x: Column, i: Column) -> Column:
        """Roles that event i draws."""
        most = F.size(roles(x)) if n < 1 else F.least(F.size(roles(x)), F.lit(n))
        times = most if n < 1 else 1 + F.pmod(F.xxhash64(key, x, i, F.lit(seed + 1)), F.greatest(most, F.lit(1)))
        return drawn(roles(x), times, key, x, i, F.lit(seed + 2))

    def grown(e: Column, i: Column) -> Column:
        x = e["event_type"]
        before = F.flatten(F.filter(F.transform(F.slice(labels, F.lit(1), i), lambda y, j: F.when(y["event_type"] == x, of_event(x, j)).otherwise(texts(()))), lambda r: F.size(r) > 0))
        more = F.array_except(F.array_except(of_event(x, i), has(x)), before)
        extra = F.transform(more, lambda r: F.struct(F.lit("").alias("argument"), r.alias("role")))
        return F.struct(e["event_trigger"].alias("event_trigger"), x.alias("event_type"), F.concat(e["arguments"], extra).alias("arguments"))

    return F.concat(F.transform(labels, grown), negatives)


def offset(text: Column, term: Column) -> Column:
    """Where a term first stands in the text, -100 where it does not; an empty one stands at 0."""
    at = F.instr(text, term)
    return F.when(at > 0, at - 1).otherwise(F.lit(-100))


def ranked(items: Column, *by) -> Column:
    """Items by the values of functions ``by``, then as they come."""
    order = F.array_sort(F.transform(items, lambda x, i: F.struct(*[f(x).alias(f"b{k}") for k, f in enumerate(by)], i.alias("i"), x.alias("x"))))
    return F.transform(order, lambda s: s["x"])


def in_random_order(task: str, labels: Column, text: Column, key: Column, seed: int) -> Column:
    """Labels by a hash of their name, then by where they first stand in the text: relations by head, then tail; events by trigger, their arguments by a hash of the role, then by place."""
    t = TASKS[task]
    rank = lambda name: F.xxhash64(key, name, F.lit(seed))
    named = lambda l: rank(l[t.name])
    if t.labels == "entity":
        return ranked(labels, named, lambda l: offset(text, l["entity"]))
    if t.labels == "relation":
        return ranked(labels, named, lambda l: offset(text, l["head"]), lambda l: offset(text, l["tail"]))
    if t.kind == "event":
        inner = lambda e: ranked(e["arguments"], lambda a: rank(a["role"]), lambda a: offset(text, a["argument"]))
        labels = F.transform(labels, lambda e: F.struct(e["event_trigger"].alias("event_trigger"), e["event_type"].alias("event_type"), inner(e).alias("arguments")))
    return ranked(labels, named, lambda l: offset(text, l["event_trigger"]))


def listed(items: Column) -> Column:
    """Texts as a list literal."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, L.quoted), ", "), F.lit("]"))


def schema_text(task: str, labels: Column, key: Column, shuffled: bool, seed: int) -> Column:
    """The schema of an instruction: names as a list, for EE and EEA a dictionary of each type's roles; in the order of ``in_random_order``, or sorted."""
    t = TASKS[task]
    order = lambda items: ranked(items, lambda x: F.xxhash64(key, x, F.lit(seed))) if shuffled else F.array_sort(items)
    names = order(F.array_distinct(F.transform(labels, lambda l: l[t.name])))
    if t.kind != "event":
        return listed(names)
    roles = lambda x: order(F.array_distinct(F.flatten(F.transform(F.filter(labels, lambda e: e["event_type"] == x), lambda e: F.transform(e["arguments"], lambda a: a["role"])))))
    return F.concat(F.lit("{"), F.array_join(F.transform(names, lambda x: F.concat(L.quoted(x), F.lit(": "), listed(roles(x)))), ", "), F.lit("}"))


def trigger_text(labels: Column) -> Column:
    """The distinct (type, trigger) pairs as a list of dictionaries, sorted."""
    pairs = F.array_sort(F.array_distinct(F.transform(labels, lambda e: F.struct(e["event_type"].alias("t"), e["event_trigger"].alias("w")))))
    one = lambda p: F.concat(F.lit("{'event_type': "), L.quoted(p["t"]), F.lit(", 'event_trigger': "), L.quoted(p["w"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(pairs, one), ", "), F.lit("]"))


def converted(records: DataFrame, task: str, templates: list[str], schema: Schema | None = None, sample: int = -1, neg_ratio: float = 0.1, neg_schema: float = 0.8, language: str = "zh", shuffled: bool = True, text: str = "text", seed: int = 2024) -> DataFrame:
    """(id, instruction, input, output) of each record (text and the task's labels).

    ``templates`` have the marks {s_format} and {s_schema}, for EEA {s_format}, {s_schema1} and {s_schema2}. At ``sample`` -1 a record draws its template and its text format,
    else both have that number (0 to 3). A share ``neg_ratio`` of the records gets placeholders, of a share ``neg_schema`` of the schema's names (one at least). Without ``schema``
    it is read off the records. Null labels are none, a null text has a null id and null draws like any other.
    """
    t = TASKS[task]
    if not -1 <= sample < len(SHOWN[t.kind, language]):
        raise ValueError(f"sample {sample} names no text format")
    if len(templates) <= max(sample, 0):
        raise ValueError(f"sample {sample} names no template of {len(templates)}")
    schema = inferred(records, task) if schema is None else schema
    size = len(set({"NER": schema.types, "RE": schema.roles, "EE": tuple(k for k, _ in schema.type_roles), "EET": schema.types, "EEA": schema.roles}[task]))
    key = F.xxhash64(F.col(text), F.lit(seed))
    labels = plain(t, F.coalesce(F.col(t.labels), F.array()))
    rows = records.select(F.col(text).alias("input"), key.alias("key"), labels.alias("labels"))
    negative = I.uniform(F.col("key"), F.lit(seed + 1)) < neg_ratio
    grown = with_negatives(task, F.col("labels"), schema, max(1, round(neg_schema * size)), F.col("key"), seed + 2)
    rows = rows.withColumn("labels", F.explode(F.array(F.when(negative, grown).otherwise(F.col("labels")))))
    if shuffled:
        rows = rows.withColumn("labels", F.explode(F.array(in_random_order(task, F.col("labels"), F.col("input"), F.col("key"), seed + 5))))
    a, b = (F.lit(sample), F.lit(sample)) if sample >= 0 else I.template_ids(F.col("key"), len(templates), len(SHOWN[t.kind, language]), seed + 6)
    rows = rows.withColumn("template", F.element_at(F.array(*[F.lit(x) for x in templates]), a + 1)).withColumn("format", b)
    write = lambda style: L.written_events(F.col("labels"), style, language) if t.kind == "event" else L.written(F.col("labels"), t.kind, style, language)
    output = F.when(F.col("format") == 0, write(0)).when(F.col("format") == 1, write(1)).when(F.col("format") == 2, write(2)).otherwise(write(3))
    shown = F.element_at(F.array(*[F.lit(x) for x in SHOWN[t.kind, language]]), F.col("format") + 1)
    told = schema_text(task, F.col("labels"), F.col("key"), shuffled, seed + 5)
    marks = {"{s_format}": shown, "{s_schema1}": told, "{s_schema2}": trigger_text(F.col("labels"))} if task == "EEA" else {"{s_format}": shown, "{s_schema}": told}
    return rows.select(F.sha2("input", 256).alias("id"), filled(F.col("template"), marks).alias("instruction"), "input", output.alias("output"))


def filled(template: Column, marks: dict[str, Column]) -> Column:
    """A template with its marks replaced, each once: what a mark stands for is not searched for others."""
    parts = F.split(template, "(?=\\{s_)|(?<=s_format\\}|s_schema\\}|s_schema[12]\\})")

    def one(x: Column) -> Column:
        out = F.when(F.lit(False), x)
        for mark, value in marks.items():
            out = out.when(x == mark, value)
        return out.otherwise(x)

    return F.array_join(F.transform(parts, one), "")


def convert_file(spark: SparkSession, task: str, source: str, target: str, templates: str, schema: str | None = None, language: str = "zh", **options) -> None:
    """The file (or folder) of JSON lines ``source`` to rows at ``target``; ``templates`` is a JSON file that has, by language, ``template`` with templates by number. Without a schema file the schema is read off the records."""
    labels = TASKS[task].labels
    records = files.json_lines(spark, source, f"text string, {labels} {LABELS[labels]}")
    row = spark.read.text(templates, wholetext=True).select(F.from_json("value", "map<string,struct<template:map<string,string>>>").alias("v")).first()
    told = row["v"][language]["template"]
    given = Schema.of(files.schema_file(spark, schema).first()) if schema and files.exists(spark, schema) else None
    out = converted(records, task, [told[k] for k in sorted(told, key=int)], given, language=language, **options)
    files.write_json_lines(out, target)
