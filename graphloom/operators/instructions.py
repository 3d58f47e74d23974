"""Annotated records to instruction data: schema chunks, negatives, labels, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(schema: Column, n: int) -> Column:
    """Chunks of ``n``; a rest of at least n / 2 is one of its own, else it joins the last. n = -1: one chunk."""
    if n < 0:
        return F.array(schema)
    size = F.size(schema)
    full = F.greatest(F.floor(size / n), F.lit(1)).cast("int")
    rest = F.greatest(size - full * n, F.lit(0))
    own = rest >= max(1.0, n / 2)
    count = F.when(own, full + 1).otherwise(full)
    length = lambda i: F.when((i == full - 1) & ~own, n + rest).otherwise(F.lit(n))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(schema, (i * n + 1).cast("int"), length(i).cast("int")))


def first_of_each(items: Column, key) -> Column:
    """The items whose key no earlier item has."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, 1, i), lambda y: key(y) == key(x)))


def by_type(labels: Column, schema: Column, kind: str, value: str) -> Column:
    """Values of the labels by type; each type of the schema is a key, empty without labels."""
    pairs = F.transform(schema, lambda t: F.struct(t, F.transform(F.filter(labels, lambda l: l[kind] == t), lambda l: l[value])))
    return F.map_from_entries(pairs)


def uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_000)) / 1e6


def negatives(every: Column, positives: Column, rate: float, key: Column, seed: int = 2024) -> Column:
    """Types that the record lacks: all at rate 1, none at 0, else as many as coins over all types say (one at least without positives), by hash."""
    left = F.array_sort(F.array_except(every, positives))
    if rate >= 1:
        return left
    if rate <= 0:
        return F.slice(left, 1, 0)
    wins = F.size(F.filter(every, lambda t: uniform(key, t, F.lit(seed)) < rate))
    k = F.least(F.when(F.size(positives) == 0, F.greatest(wins, F.lit(1))).otherwise(wins), F.size(left))
    order = F.array_sort(F.transform(left, lambda t: F.struct(F.xxhash64(key, t, F.lit(seed + 1)).alias("h"), t.alias("t"))))
    return F.slice(F.transform(order, lambda s: s["t"]), 1, k)


def instruction(text: Column, schema: Column, sentence: str) -> Column:
    return F.to_json(F.struct(F.lit(sentence).alias("instruction"), schema.alias("schema"), text.alias("input")))


def rows(records: DataFrame, text: str, schema: Column, n: int, sentence: str, task: str, source: str) -> DataFrame:
    """A row for each record and chunk: id (SHA-256 of the text), task, source, instruction, chunk."""
    c = records.withColumn("chunk", F.explode(chunks(schema, n)))
    return c.select(F.sha2(F.col(text), 256).alias("id"), F.lit(task).alias("task"), F.lit(source).alias("source"), instruction(F.col(text), F.col("chunk"), sentence).alias("instruction"), "chunk")


def split(records: DataFrame, key: str, share: float = 0.05, seed: int = 2024) -> tuple[DataFrame, DataFrame]:
    """(train, test) of exact sizes: the last floor(n share) rows in the order of a hash go to the test set.

    The hash's upper 16 bits, then the next 16, are counted to find the bucket that the cut falls in; only its rows, one in 2^32 of all,
    are put in order, by the key and then all their columns. Rows of one key may fall on both sides of the cut; equal rows are counted, not told apart.
    """
    r = records.withColumn("s_hash", F.xxhash64(F.lit(seed), F.col(key)))
    bucket = lambda shift: F.shiftright("s_hash", shift)
    left, cut, part = None, None, r
    for shift in (48, 32):
        counts = sorted(((x["b"], x["n"]) for x in part.groupBy(bucket(shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # 2^16 rows at most
        left = int(sum(n for _, n in counts) * share) if left is None else left
        for cut, n in counts:
            if n >= left:
                break
            left -= n
        part = r.where(bucket(shift) == cut) if cut is not None else r
    if cut is None:
        return r.drop("s_hash"), r.drop("s_hash")
    # equal rows are one row with a count, so that a second evaluation can't deal them otherwise
    names = [F.col(f"`{c}`") for c in records.columns]
    told = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    edge = r.where(bucket(32) == cut).withColumn("s_row", told).groupBy("s_hash", "s_row").agg(F.first(F.struct(*names)).alias("s_own"), F.count(F.lit(1)).alias("s_n"))
    upto = F.sum("s_n").over(Window.partitionBy(bucket(32)).orderBy(F.desc("s_hash"), "s_row").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("s_test", F.greatest(F.lit(0), F.least("s_n", F.lit(left) - (upto - F.col("s_n")))))
    times = lambda n: edge.withColumn("s_i", F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select("s_own.*")
    train = r.where(bucket(32) < cut).drop("s_hash").unionByName(times(F.col("s_n") - F.col("s_test")))
    return train, r.where(bucket(32) > cut).drop("s_hash").unionByName(times(F.col("s_test")))


def typed_lines(labels: Column, kind: str, value: str) -> Column:
    """``type：value`` lines; empty values and lists read NAN."""
    line = F.transform(labels, lambda l: F.concat(l[kind], F.lit("："), F.when(l[value] == "", F.lit("NAN")).otherwise(l[value])))
    return F.when(F.size(labels) == 0, F.lit("NAN")).otherwise(F.array_join(line, "\n"))


def sampled(items: Column, every: Column, taken: Column, rate: float, *key: Column, seed: int = 2024) -> Column:
    """``negatives`` by a key of several columns: of ``every`` those not ``taken``, as many as coins say; then ``items``, in a hashed order."""
    both = F.concat(negatives(every, taken, rate, F.xxhash64(*key), seed), items)
    order = F.array_sort(F.transform(both, lambda x: F.struct(F.xxhash64(*key, x, F.lit(seed + 2)).alias("h"), x.alias("x"))))
    return F.transform(order, lambda s: s["x"])


def event_schemas(events: Column, type_roles: Column, rate: float, role_rate: float, key: Column, seed: int = 2024) -> Column:
    """Schemas (event_type, trigger, arguments) of a record: its own types with their roles, and negatives on both levels.

    ``type_roles`` maps each type to its roles. At rate 0 the own types alone, with all their roles; at rate 1 all types with all
    roles; between them, types and the roles of each type are sampled. Types that the map lacks have no roles.
    """
    none = F.array().cast("array<string>")
    own = F.coalesce(F.array_distinct(F.transform(events, lambda e: e["event_type"])), none)
    types = F.concat(F.array_sort(own), negatives(F.map_keys(type_roles), own, rate, key, seed))

    def schema(t: Column) -> Column:
        roles = F.coalesce(F.try_element_at(type_roles, t), none)
        has = F.coalesce(F.array_distinct(F.flatten(F.transform(F.filter(events, lambda e: e["event_type"] == t), lambda e: F.transform(e["arguments"], lambda a: a["role"])))), none)
        chosen = roles if rate <= 0 or rate >= 1 else sampled(has, roles, has, role_rate, key, t, seed=seed)
        return F.struct(t.alias("event_type"), F.lit(True).alias("trigger"), F.array_distinct(F.concat(chosen, has) if rate <= 0 or rate >= 1 else chosen).alias("arguments"))

    return F.transform(types, schema)


def with_hard_negatives(records: DataFrame, key: str, positives: str, confusable: DataFrame, kind: str, others: str, every: Column, n: int, seed: int = 2024, out: str = "schema") -> DataFrame:
    """``records`` and ``out``: their positives, all that ``confusable`` (kind, array of others) names for these, and up to ``n`` of the rest by hash.

    Types without an entry add none; records without positives get ``n`` types (all, if fewer).
    """
    near = records.select(F.col(key).alias("n_key"), F.explode(positives).alias("n_type")).join(confusable.select(F.col(kind).alias("n_kind"), F.col(others).alias("n_others")), F.col("n_type") == F.col("n_kind"))
    near = near.groupBy("n_key").agg(F.array_distinct(F.flatten(F.collect_set("n_others"))).alias("n_near"))
    j = records.join(near, F.col(key) == F.col("n_key"), "left")
    cluster = F.array_sort(F.array_union(F.col(positives), F.coalesce("n_near", F.array().cast("array<string>"))))
    rest = F.transform(F.array_sort(F.transform(F.array_except(every, cluster), lambda t: F.struct(F.xxhash64(F.col(key), t, F.lit(seed)).alias("h"), t.alias("t")))), lambda s: s["t"])
    return j.withColumn(out, F.concat(cluster, F.slice(rest, 1, n))).drop("n_key", "n_near")


def json_text(c: Column) -> Column:
    """A text as JSON, with its quotes."""
    return F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1")


def value_json(values: Column) -> Column:
    """``"NAN"`` without values, one value as it is, several as a list."""
    return F.when(F.size(values) == 0, F.lit('"NAN"')).when(F.size(values) == 1, json_text(F.get(values, F.lit(0)))).otherwise(F.to_json(values))


def object_json(keys: Column, value) -> Column:
    """A JSON object of ``value(key)`` for each key; {} without keys."""
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(json_text(k), F.lit(":"), value(k))), ","), F.lit("}"))


def relation_target(relations: Column, schema: Column) -> Column:
    """JSON of (subject, object) pairs by relation, a key for each of the schema."""
    pairs = lambda r: F.to_json(F.transform(F.filter(relations, lambda l: l["relation"] == r), lambda l: F.struct(l["head"].alias("subject"), l["tail"].alias("object"))))
    return object_json(F.array_distinct(schema), pairs)


def event_target(events: Column, schema: Column, text: Column, with_trigger: bool = True) -> Column:
    """JSON of the events of each type of ``schema`` (event_type, arguments), in the order of where their trigger first stands in the text.

    Arguments hold each role of the schema: NAN without a value; {} if the event has none of them. Empty arguments count as none,
    a missing or empty trigger reads NAN, and an event without a trigger and without arguments goes. Without triggers, events without a role of the schema go too.
    """
    has_trigger = lambda e: F.coalesce(e["event_trigger"], F.lit("")) != ""
    trigger_of = lambda e: F.when(has_trigger(e), e["event_trigger"]).otherwise("NAN")
    given = lambda e: F.filter(F.coalesce(e["arguments"], F.array()), lambda a: F.coalesce(a["argument"], F.lit("")) != "")
    fits = lambda e, roles: F.exists(given(e), lambda a: F.array_contains(roles, a["role"]))

    def told(e: Column, roles: Column) -> Column:
        of = lambda r: F.array_distinct(F.transform(F.filter(given(e), lambda a: a["role"] == r), lambda a: a["argument"]))
        args = F.when(fits(e, roles), object_json(roles, lambda r: value_json(of(r)))).otherwise("{}")
        trigger = [F.lit('"trigger":'), json_text(trigger_of(e)), F.lit(",")] if with_trigger else []
        return F.concat(F.lit("{"), *trigger, F.lit('"arguments":'), args, F.lit("}"))

    def of_type(s: Column) -> Column:
        real = lambda e: has_trigger(e) | (F.size(F.coalesce(e["arguments"], F.array())) > 0)
        own = F.filter(events, lambda e: (e["event_type"] == s["event_type"]) & (real(e) if with_trigger else fits(e, s["arguments"])))
        place = lambda e: F.instr(text, trigger_of(e)) if with_trigger else F.lit(0)
        order = F.array_sort(F.transform(own, lambda e, i: F.struct(F.coalesce(place(e), F.lit(0)).alias("at"), i.alias("i"), told(e, s["arguments"]).alias("t"))))
        return F.concat(json_text(s["event_type"]), F.lit(":["), F.array_join(F.transform(order, lambda x: x["t"]), ","), F.lit("]"))

    return F.concat(F.lit("{"), F.array_join(F.transform(schema, of_type), ","), F.lit("}"))


def attribute_target(relations: Column, schema: Column, text: Column) -> Column:
    """JSON of the attributes of each head, by where heads and values first stand in the text: one value as it is, several as a list. Only relations of the schema."""
    own = F.filter(relations, lambda l: F.array_contains(schema, l["relation"]))
    placed = lambda items: F.transform(F.array_sort(F.transform(F.array_distinct(items), lambda v: F.struct(F.instr(text, v).alias("at"), v.alias("v")))), lambda s: s["v"])
    heads = placed(F.transform(own, lambda l: l["head"]))

    def of_head(h: Column) -> Column:
        mine = F.filter(own, lambda l: l["head"] == h)
        held = F.filter(schema, lambda r: F.exists(mine, lambda l: l["relation"] == r))
        return object_json(held, lambda r: value_json(placed(F.transform(F.filter(mine, lambda l: l["relation"] == r), lambda l: l["tail"]))))

    return object_json(heads, of_head)


def template_ids(key: Column, templates: int = 20, formats: int = 4, seed: int = 2024) -> tuple[Column, Column]:
    """A template's and a format's number for each record, drawn by hashes apart from each other."""
    draw = lambda n, s: F.pmod(F.xxhash64(key, F.lit(s)), F.lit(n)).cast("int")
    return draw(templates, seed), draw(formats, seed + 1)


def test_rows(records: DataFrame, text: str, schema: Column, n: int, sentence: str) -> DataFrame:
    """(id, split, instruction, input): a row for each record and slice of the schema, ``split`` its number."""
    c = records.select(F.col(text).alias("input"), F.posexplode(chunks(schema, n)).alias("split", "chunk"))
    told = F.replace(F.lit(sentence), F.lit("{schema}"), F.to_json("chunk"))
    return c.select(F.sha2("input", 256).alias("id"), "split", told.alias("instruction"), "input")
