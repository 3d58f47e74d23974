"""The property graph end to end: nodes in their order, tags to the nodes that bear them, objects to the labels of their tags, containment."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from graphloom.operators import graph as G

# The labels in the order in which they are built, and the relation of an object to each label that its tags name.
ORDER = ("Tag", "Facility", "TaskForce", "GroupOfInterest", "Canon", "Character", "Series", "Attribute", "SCP")
RELATIONS = {
    "Tag": "HAS_TAG",
    "Attribute": "HAS_ATTRIBUTE",
    "Character": "RELATE_TO_CHARACTER",
    "GroupOfInterest": "RELATE_TO_GROUP",
    "Series": "BELONG_T0_SERIES",
    "Canon": "BELONG_T0_CANON",
}


def tag_fan_outs(objects: DataFrame, key: str, tags: str, nodes: dict[str, DataFrame], tag: str = "tag", relations: dict[str, str] = RELATIONS) -> DataFrame:
    """(src, rel, dst_label, dst): an edge from each object to each node of a label whose tag it has, once however often the list holds it.

    The lists are opened once and meet all labels in one join. Null and empty lists, tags without a node and null tags have no edges.
    """
    targets = [n.where(F.col(tag).isNotNull()).select(F.lit(l).alias("dst_label"), F.lit(relations[l]).alias("rel"), F.col(tag).alias("dst")).distinct() for l, n in nodes.items() if l in relations]
    every = reduce(DataFrame.unionByName, targets)
    own = objects.select(F.col(key).alias("src"), F.explode(F.array_distinct(tags)).alias("t"))
    return own.join(every, F.col("t") == F.col("dst")).select("src", "rel", "dst_label", "dst")


def built(sources: dict[str, DataFrame], key: str = "tag", object_key: str = "item", tags: str = "tag_list") -> tuple[dict[str, DataFrame], DataFrame]:
    """(nodes by label in ORDER, edges) of the tables by label; labels without a table are left out. Objects are the label SCP."""
    nodes = {l: sources[l] for l in ORDER if l in sources}
    labelled = {l: n for l, n in nodes.items() if l in RELATIONS}
    return nodes, tag_fan_outs(nodes["SCP"], object_key, tags, labelled, key)


#: Labels whose nodes are tails of their tag, and the relations of objects to what holds them.
TAGGED = ("GroupOfInterest", "Canon", "Character", "Series", "Attribute")
IS_TAG_OF, IN_FACILITY, BY_FORCE = "IS_TAG_OF", "IS_CONTAINED_IN_FACILITY", "IS_CONTAINED_BY_TASKFORCE"
EDGE = ("src_label", "src", "rel", "dst_label", "dst", "n")


@dataclass(frozen=True)
class Holders:
    """Nodes that hold objects: their key, the objects' keys (an array, or one a row, so that no node's objects are gathered), and the column that tells which come first."""

    nodes: DataFrame
    key: str
    objects: str
    order: str | None = None


def contained(objects: DataFrame, key: str, holders: Holders, rel: str, first: bool = False) -> DataFrame:
    """(src, rel, dst): objects that a holder's list names. With ``first`` an object belongs to the first holder that names it alone; ties go by the holder's key."""
    o = F.col(holders.objects)
    listed = isinstance(holders.nodes.schema[holders.objects].dataType, ArrayType)
    h = holders.nodes.select(F.col(holders.key).cast("string").alias("dst"), F.col(holders.order or holders.key).alias("at"), (F.explode(o) if listed else o).alias("o"))
    if first:
        h = h.groupBy("o").agg(F.min(F.struct("at", "dst")).alias("f")).select("o", F.col("f.dst").alias("dst"))
    else:
        h = h.select("o", "dst").distinct()
    return h.join(objects.select(F.col(key).alias("src")), F.col("o") == F.col("src")).select(F.col("src").cast("string").alias("src"), F.lit(rel).alias("rel"), "dst")


def all_tags(tags: DataFrame, nodes: dict[str, DataFrame], objects: DataFrame, tag: str, tag_list: str) -> DataFrame:
    """The tag nodes and, for each tag of a node or an object that has none, one of the tag alone; its other properties are null."""
    wanted = [n.select(F.col(tag).alias("w")) for l, n in nodes.items() if l in TAGGED] + [objects.select(F.explode(tag_list).alias("w"))]
    return tags.unionByName(G.missing(reduce(DataFrame.unionByName, wanted), "w", tags, tag), allowMissingColumns=True)


def built_graph(sources: dict[str, DataFrame], keys: dict[str, str], tag: str = "tag", tag_list: str = "tag_list", facilities: Holders | None = None, forces: Holders | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(nodes by label in ORDER, edges EDGE) of the tables by label, with their keys by label (``tag`` where none is given).

    Tags without a node get one. A node of a tagged label is a tail of its tag, as often as records of the label share the tag (``n``); an object is the
    head of an edge to each node of the labels in RELATIONS whose tag it has, to the first facility that lists it, and to all task forces that do.
    Every key is a text in the edges; ``n`` is 1 in the others.
    """
    nodes = {l: sources[l] for l in ORDER if l in sources}
    objects, key = nodes["SCP"], keys["SCP"]
    nodes["Tag"] = all_tags(nodes["Tag"], nodes, objects, tag, tag_list)
    key_of = lambda l: keys.get(l, tag)
    parts = []
    for l in TAGGED:
        if l in nodes:
            own = nodes[l].where(F.col(tag).isNotNull()).withColumn("src", F.col(tag)).select("src", F.col(key_of(l)).cast("string").alias("dst"))
            times = own.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
            parts.append(own.distinct().join(times, "src").select(F.lit("Tag").alias("src_label"), "src", F.lit(IS_TAG_OF).alias("rel"), F.lit(l).alias("dst_label"), "dst", "n"))
    one = lambda e, label: e.select(F.lit("SCP").alias("src_label"), F.col("src").cast("string").alias("src"), "rel", label.alias("dst_label"), F.col("dst").cast("string").alias("dst"), F.lit(1).cast("long").alias("n"))
    if facilities is not None:
        parts.append(one(contained(objects, key, facilities, IN_FACILITY, first=True), F.lit("Facility")))
    if forces is not None:
        parts.append(one(contained(objects, key, forces, BY_FORCE), F.lit("TaskForce")))
    fan = reduce(DataFrame.unionByName, [nodes[l].where(F.col(tag).isNotNull()).select(F.lit(l).alias("dst_label"), F.lit(r).alias("rel"), F.col(tag).alias("t"), F.col(key_of(l)).cast("string").alias("dst")).distinct() for l, r in RELATIONS.items() if l in nodes])
    own = objects.select(F.col(key).alias("src"), F.explode(F.array_distinct(tag_list)).alias("t"))
    parts.append(one(own.join(fan, "t"), F.col("dst_label")))
    return nodes, reduce(DataFrame.unionByName, parts)
