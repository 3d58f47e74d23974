"""Annotated records to instruction rows, end to end, for each extraction task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import instructions as I
from graphloom.sources import files

# The sentence of each task and language, which models were trained on.
INSTRUCTIONS = {
    ("NER", "zh"): "你是专门进行实体抽取的专家。请从input中抽取出符合schema定义的实体，不存在的实体类型返回空列表。请按照JSON字符串的格式回答。",
    ("RE", "zh"): "你是专门进行关系抽取的专家。请从input中抽取出符合schema定义的关系三元组，不存在的关系返回空列表。请按照JSON字符串的格式回答。",
    ("SPO", "zh"): "你是专门进行关系抽取的专家。请从input中抽取出符合schema定义的关系三元组，不存在的关系返回空列表。请按照JSON字符串的格式回答。",
    ("EE", "zh"): "你是专门进行事件提取的专家。请从input中抽取出符合schema定义的事件，不存在的事件返回空列表，不存在的论元返回NAN，如果论元存在多值请返回列表。请按照JSON字符串的格式回答。",
    ("EET", "zh"): "你是专门进行事件提取的专家。请从input中抽取出符合schema定义的事件类型及事件触发词，不存在的事件返回空列表。请按照JSON字符串的格式回答。",
    ("EEA", "zh"): "你是专门进行事件论元提取的专家。请从input中抽取出符合schema定义的事件论元及论元角色，不存在的论元返回NAN或空字典，如果论元存在多值请返回列表。请按照JSON字符串的格式回答。",
    ("KG", "zh"): "你是一个图谱实体知识结构化专家。根据输入实体类型(entity type)的schema描述，从文本中抽取出相应的实体实例和其属性信息，不存在的属性不输出, 属性存在多值就返回列表，并输出为可解析的json格式。",
    ("NER", "en"): "You are an expert in named entity recognition. Please extract entities that match the schema definition from the input. Return an empty list if the entity type does not exist. Please respond in the format of a JSON string.",
    ("RE", "en"): "You are an expert in relationship extraction. Please extract relationship triples that match the schema definition from the input. Return an empty list for relationships that do not exist. Please respond in the format of a JSON string.",
    ("SPO", "en"): "You are an expert in relationship extraction. Please extract relationship triples that match the schema definition from the input. Return an empty list for relationships that do not exist. Please respond in the format of a JSON string.",
    ("EE", "en"): "You are an expert in event extraction. Please extract events from the input that conform to the schema definition. Return an empty list for events that do not exist, and return NAN for arguments that do not exist. If an argument has multiple values, please return a list. Respond in the format of a JSON string.",
    ("EET", "en"): "You are an expert in event extraction. Please extract event types and event trigger words from the input that conform to the schema definition. Return an empty list for non-existent events. Please respond in the format of a JSON string.",
    ("EEA", "en"): "You are an expert in event argument extraction. Please extract event arguments and their roles from the input that conform to the schema definition, which already includes event trigger words. If an argument does not exist, return NAN or an empty dictionary. Please respond in the format of a JSON string.",
    ("KG", "en"): "You are an expert in structured knowledge systems for graph entities. Based on the schema description of the input entity type, you extract the corresponding entity instances and their attribute information from the text. Attributes that do not exist should not be output. If an attribute has multiple values, a list should be returned. The results should be output in a parsable JSON format.",
}


#: Types of the columns of labels as files hold them.
LABELS = {
    "entity": "array<struct<entity:string,entity_type:string>>",
    "relation": "array<struct<head:string,head_type:string,relation:string,tail:string,tail_type:string>>",
    "event": "array<struct<event_trigger:string,event_type:string,arguments:array<struct<argument:string,role:string>>>>",
}


@dataclass(frozen=True)
class Schema:
    """A schema file's three lines."""

    types: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    type_roles: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @classmethod
    def of(cls, row) -> Schema:
        """Of a row (types, roles, type_roles) as ``sources.files.schema_file`` gives it."""
        pairs = sorted((k, tuple(v)) for k, v in (row["type_roles"] or {}).items())
        return cls(tuple(row["types"] or ()), tuple(row["roles"] or ()), tuple(pairs))

    @classmethod
    def of_topics(cls, rows) -> Schema:
        """Of rows (topic, relations) as ``sources.files.topic_file`` gives them: topics are types, their relations roles."""
        pairs = sorted((r["topic"], tuple(r["relations"])) for r in rows)
        return cls(tuple(t for t, _ in pairs), tuple(sorted({x for _, r in pairs for x in r})), tuple(pairs))


def texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def structs(rows: list[Column], kind: str) -> Column:
    return F.array(*rows) if rows else F.array().cast(f"array<{kind}>")


EVENT = "struct<event_type:string,trigger:boolean,arguments:array<string>>"


def event_items(s: Schema) -> Column:
    return structs([F.struct(F.lit(t).alias("event_type"), F.lit(True).alias("trigger"), texts(r).alias("arguments")) for t, r in s.type_roles], EVENT)


def own_event_items(s: Schema) -> Column:
    """The record's own event types, with the roles of the schema (none if it lacks the type)."""
    own = F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col("event"), F.array()), lambda e: e["event_type"])))
    return F.transform(own, lambda t: F.struct(t.alias("event_type"), roles_of(s, t).alias("arguments")))


def roles_of(s: Schema, t: Column) -> Column:
    all_roles = F.map_from_entries(structs([F.struct(F.lit(k), texts(r)) for k, r in s.type_roles], "struct<k:string,v:array<string>>"))
    return F.coalesce(F.try_element_at(all_roles, t), texts(()))


def triggered_items(s: Schema, labels: Column, rate: float, key: Column, shuffled: bool, seed: int) -> Column:
    """The record's own event types with their triggers, repeats included, and roles, in order or by hash.

    Below rate 1 roles and triggers are drawn, one at least; there are never more triggers than roles.
    """
    own = F.array_sort(F.array_distinct(F.transform(labels, lambda e: e["event_type"])))
    drawn = lambda items, k: items if rate >= 1 else F.slice(in_order(items, key, seed + 3), 1, F.greatest(F.lit(1), k.cast("int")))
    coins = lambda items, n: F.size(F.filter(F.sequence(F.lit(1), F.size(items)), lambda i: I.uniform(key, i, F.lit(seed + n)) < rate))

    def item(t: Column) -> Column:
        roles, triggers = roles_of(s, t), F.transform(F.filter(labels, lambda e: e["event_type"] == t), lambda e: F.coalesce(e["event_trigger"], F.lit("")))
        roles = F.when(F.size(roles) == 0, roles).otherwise(drawn(roles, coins(roles, 4)))
        triggers = F.slice(drawn(triggers, coins(triggers, 5)), F.lit(1), F.size(roles))
        return F.struct(t.alias("event_type"), triggers.alias("trigger"), (in_order(roles, key, seed + 2) if shuffled else roles).alias("arguments"))

    return F.transform(in_order(own, key, seed + 2) if shuffled else own, item)


def in_order(items: Column, key: Column, seed: int) -> Column:
    """Items in an order by hash of the record."""
    order = F.array_sort(F.transform(items, lambda x, i: F.struct(F.xxhash64(key, x, i, F.lit(seed)).alias("h"), x.alias("x"))))
    return F.transform(order, lambda s: s["x"])


def triple_items(s: Schema) -> Column:
    """SPO types are ``head_relation_tail``."""
    cut = [t.split("_") for t in sorted(set(s.types))]
    rows = [F.struct(F.lit(p[0]).alias("subject_type"), F.lit("_".join(p[1:-1])).alias("predicate"), F.lit(p[-1]).alias("object_type")) for p in cut]
    return structs(rows, "struct<subject_type:string,predicate:string,object_type:string>")


def entity_items(s: Schema) -> Column:
    return structs([F.struct(F.lit(t).alias("entity_type"), texts(r).alias("attributes")) for t, r in s.type_roles], "struct<entity_type:string,attributes:array<string>>")


def lists_by(kind: str, value: str) -> Callable:
    def output(labels: Column, items: Column, text: Column) -> Column:
        mine = lambda t: F.transform(F.filter(labels, lambda l: l[kind] == t), lambda l: l[value])
        return I.object_json(items, lambda t: F.to_json(mine(t)))

    return output


def triples(labels: Column, items: Column, text: Column) -> Column:
    """(subject, object) pairs by predicate, of the types of the item."""
    fits = lambda l, s: (l["relation"] == s["predicate"]) & (l["head_type"] == s["subject_type"]) & (l["tail_type"] == s["object_type"])
    pairs = lambda s: F.to_json(F.transform(F.filter(labels, lambda l: fits(l, s)), lambda l: F.struct(l["head"].alias("subject"), l["tail"].alias("object"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(items, lambda s: F.concat(I.json_text(s["predicate"]), F.lit(":"), pairs(s))), ","), F.lit("}"))


def attributes(labels: Column, items: Column, text: Column) -> Column:
    each = F.transform(items, lambda s: F.concat(I.json_text(s["entity_type"]), F.lit(":"), I.attribute_target(labels, s["attributes"], text)))
    return F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))


def whole(item: Column) -> Column:
    return item


def triple_type(item: Column) -> Column:
    return F.concat_ws("_", item["subject_type"], item["predicate"], item["object_type"])


@dataclass(frozen=True)
class Task:
    """A task's parts: the column of its labels, candidate schema items, the name of an item and of a label's item, and the output of a chunk."""

    labels: str
    candidates: Callable[[Schema], Column]
    item_type: Callable[[Column], Column]
    label_type: Callable[[Column], Column]
    output: Callable[[Column, Column, Column], Column]


def field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


TASKS = {
    "NER": Task("entity", lambda s: texts(sorted(set(s.types))), whole, field("entity_type"), lists_by("entity_type", "entity")),
    "RE": Task("relation", lambda s: texts(sorted(set(s.roles))), whole, field("relation"), lambda labels, items, text: I.relation_target(labels, items)),
    "SPO": Task("relation", triple_items, triple_type, lambda l: F.concat_ws("_", l["head_type"], l["relation"], l["tail_type"]), triples),
    "EE": Task("event", event_items, field("event_type"), field("event_type"), lambda labels, items, text: I.event_target(labels, items, text)),
    "EET": Task("event", lambda s: texts(sorted(set(s.types))), whole, field("event_type"), lists_by("event_type", "event_trigger")),
    "EEA": Task("event", own_event_items, field("event_type"), field("event_type"), lambda labels, items, text: I.event_target(labels, items, text)),
    "KG": Task("relation", entity_items, field("entity_type"), None, attributes),
}


def label_key(task: str, item: Column) -> Column:
    """The key of a schema item in the output: the predicate of a triple, else the item's type."""
    return item["predicate"] if task == "SPO" else TASKS[task].item_type(item)


def source_of(path: str) -> str:
    """A file's source: the name of its folder."""
    return path.rstrip("/").split("/")[-2]


def sampled_items(t: Task, schema: Schema, labels: Column, rate: float, key: Column, shuffled: bool, seed: int) -> Column:
    """The record's own items first, then negatives; all in an order by hash if ``shuffled``."""
    every = t.candidates(schema)
    if t.label_type is None:
        return every
    names = F.transform(every, t.item_type)
    own = F.array_intersect(names, F.coalesce(F.transform(labels, t.label_type), texts(())))
    chosen = F.concat(own, I.negatives(names, own, rate, key, seed))
    chosen = in_order(chosen, key, seed + 2) if shuffled else chosen
    return F.transform(chosen, lambda n: F.get(F.filter(every, lambda i: t.item_type(i) == n), F.lit(0)))


def converted(records: DataFrame, task: str, schema: Schema, source: str, n: int, split: str = "train", rate: float = 1.0, language: str = "zh", text: str = "text", shuffled: bool = True, seed: int = 2024) -> DataFrame:
    """Instruction rows of ``records`` (text and the task's labels), a row for each chunk of ``n`` schema items.

    ``train``: task, source, instruction, output, the schema being the record's items and negatives at ``rate``. ``test``: id (SHA-256 of the text), task,
    source, instruction and, if the records have labels, label (their JSON); the schema is all candidates. Null labels are none; records of an empty schema have no rows; null texts have null ids and no ``input``.
    """
    t = TASKS[task]
    has = t.labels in records.columns
    labels = F.coalesce(F.col(t.labels), F.array()) if has else None
    c_text = F.col(text)
    if split == "train" and task == "EEA":
        items = triggered_items(schema, labels, rate, F.xxhash64(c_text), shuffled, seed)
    elif split == "train":
        items = sampled_items(t, schema, labels, rate, F.xxhash64(c_text), shuffled, seed)
    else:
        items = t.candidates(schema) if task != "EEA" or has else F.array().cast("array<struct<event_type:string,arguments:array<string>>>")
    rows = records.withColumn("c_items", F.explode(F.array(items))).where(F.size("c_items") > 0)
    rows = rows.withColumn("c_chunk", F.explode(I.chunks(F.col("c_items"), n)))
    told = I.instruction(c_text, F.col("c_chunk"), INSTRUCTIONS[task, language]).alias("instruction")
    head = [F.lit(task).alias("task"), F.lit(source).alias("source"), told]
    if split == "train":
        return rows.select(*head, t.output(labels, F.col("c_chunk"), c_text).alias("output"))
    return rows.select(F.sha2(c_text, 256).alias("id"), *head, *([F.to_json(F.col(t.labels)).alias("label")] if has else []))


def convert_file(spark: SparkSession, task: str, source: str, target: str, schema: str, n: int, split: str = "train", rate: float = 1.0, language: str = "zh", shuffled: bool = True, seed: int = 2024) -> None:
    """The file (or folder) of JSON lines ``source`` to instruction rows at ``target``, also JSON lines, by the schema file ``schema``.

    Records need the task's labels but for a test set; those of EEA without events go. The rows' source is the name of the file's folder.
    """
    labels = TASKS[task].labels
    records = files.json_lines(spark, source, f"text string, {labels} {LABELS[labels]}")
    records = records.where(F.size(labels) > 0) if task == "EEA" else records
    told = Schema.of(files.schema_file(spark, schema).first())
    out = converted(records, task, told, source_of(source), n, split, rate, language, shuffled=shuffled, seed=seed)
    files.write_json_lines(out, target)
