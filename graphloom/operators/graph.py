"""Property graph as node and edge tables, and pattern queries over them.

Nodes: one DataFrame a label, with a key column. Edges: (src, rel, dst). A path is a bag of rows, as joins give it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def create_nodes(existing: DataFrame, new: DataFrame, merge: bool = False) -> DataFrame:
    """Appends nodes; with ``merge`` only those that differ from all in some property (null keys go)."""
    both = existing.unionByName(new, allowMissingColumns=True)
    return both.dropna(how="all").dropDuplicates() if merge else both


def edges(heads: DataFrame, head_key: str, values: Column, tails: DataFrame, tail_key: str, rel: str) -> DataFrame:
    """An edge for each head, value of its list and tail with that key; lists or keys without a partner drop silently."""
    h = heads.select(F.col(head_key).alias("src"), F.explode(values).alias("v"))
    t = tails.select(F.col(tail_key).alias("dst"))
    return h.join(t, F.col("v") == F.col("dst")).select("src", F.lit(rel).alias("rel"), "dst")


def edges_to(heads: DataFrame, head_key: str, tails: DataFrame, tail_key: str, values: Column, rel: str) -> DataFrame:
    """The mirror of ``edges``: an edge for each tail, value of its list and head with that key."""
    back = edges(tails, tail_key, values, heads, head_key, rel)
    return back.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))


def property_values(nodes: DataFrame, prop: str) -> DataFrame:
    """The values of a property that nodes have, one a node."""
    return nodes.where(F.col(prop).isNotNull()).select(prop)


def count_nodes(nodes: dict[str, DataFrame], label: str | None = None) -> DataFrame:
    """(label, n) of one label or of all."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [n.agg(F.count(F.lit(1)).alias("n")).select(F.lit(l).alias("label"), "n") for l, n in nodes.items() if label in (None, l)])


def indexed(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes dealt and sorted by ``key``, so that files written of them are told apart by its least and greatest values."""
    return nodes.repartitionByRange(F.col(key)).sortWithinPartitions(key)


def key_edges(heads: DataFrame, head_key: str, head_on: str, tails: DataFrame, tail_key: str, tail_on: str, rel: str) -> DataFrame:
    """An edge for each pair of nodes that agree on a property."""
    h = heads.select(F.col(head_key).alias("src"), F.col(head_on).alias("a"))
    t = tails.select(F.col(tail_key).alias("dst"), F.col(tail_on).alias("b"))
    return h.join(t, F.col("a") == F.col("b")).select("src", F.lit(rel).alias("rel"), "dst")


def first_wins(pairs: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the pair that comes first (aggregated before the shuffle)."""
    rest = [c for c in pairs.columns if c != key]
    least = F.min(F.struct(order, *[c for c in rest if c != order])).alias("s")
    return pairs.groupBy(key).agg(least).select(key, *[F.col(f"s.{c}").alias(c) for c in rest])


def missing(wanted: DataFrame, column: str, nodes: DataFrame, key: str) -> DataFrame:
    """Distinct non-null values that no node has."""
    w = wanted.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct()
    return w.join(nodes.select(key), key, "left_anti")


def as_tail(nodes: DataFrame, key: str, tag: str, heads: DataFrame, head_key: str, rel: str, bag: bool = False) -> DataFrame:
    """Edges from heads to the nodes of their tag; with ``bag`` also ``n``, how often each is there: as often as records share the tag."""
    e = key_edges(heads, head_key, head_key, nodes, key, tag, rel)
    if not bag:
        return e.distinct()
    k = nodes.groupBy(F.col(tag).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(k, F.col("src") == F.col("t")).select("src", "rel", "dst", "n")


def count_edges(e: DataFrame) -> DataFrame:
    return e.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def find(nodes: DataFrame, prop: str, value) -> DataFrame:
    return nodes.where(F.col(prop) == F.lit(value))


def schema_text(nodes: dict[str, DataFrame], e: DataFrame) -> tuple[dict[str, str], DataFrame]:
    """Labels with their properties, and the distinct relations."""
    return {k: v.schema.simpleString() for k, v in nodes.items()}, e.select("rel").distinct()


class Pattern:
    """A path pattern: ``Pattern(nodes, cond).out(edges, nodes, cond)...``; ``rows`` holds a struct for each name.

    Beside its struct a node's columns stay as they are (``p_`` name ``_`` column), and joins are on these, so that tables bucketed by a
    key keep their layout through a step.
    """

    def __init__(self, nodes: DataFrame, name: str, where: Column | None = None):
        self.rows, self.last = self._named(nodes, name, where), name

    @staticmethod
    def _named(nodes: DataFrame, name: str, where: Column | None) -> DataFrame:
        n = nodes if where is None else nodes.where(where)
        return n.select(F.struct(*n.columns).alias(name), *[F.col(f"`{c}`").alias(f"p_{name}_{c}") for c in n.columns])

    def out(self, e: DataFrame, key: str, nodes: DataFrame, name: str, to_key: str, where: Column | None = None, back: bool = False) -> Pattern:
        a, b = ("dst", "src") if back else ("src", "dst")
        step = e.select(F.col(a).alias("p_from"), F.col(b).alias("p_to"))
        rows = self.rows.join(step, F.col(f"p_{self.last}_{key}") == F.col("p_from"))
        self.rows = rows.join(self._named(nodes, name, where), F.col("p_to") == F.col(f"p_{name}_{to_key}")).drop("p_from", "p_to")
        self.last = name
        return self

    def where(self, cond: Column) -> Pattern:
        self.rows = self.rows.where(cond)
        return self

    def returns(self, *columns: Column) -> DataFrame:
        return self.rows.select(*columns)


def runs(df: DataFrame, by: list[str], value: str, least: str | None = None, block: int = 4096) -> DataFrame:
    """Runs of consecutive integers of each group: run_start, run_end, n, and the least of the column ``least``, if one is given. Null values go.

    Runs are found within blocks of ids, so that a group of any size is split; only runs that touch a block's edge, two a
    block at most, meet those of their whole group.
    """
    low = [F.min(least).alias(least)] if least else []
    ids = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("r_id")).agg(*(low or [F.count(F.lit(1)).alias("r_n")]))
    ids = ids.withColumn("r_block", F.floor(F.col("r_id") / block))
    w = Window.partitionBy(*by, "r_block").orderBy("r_id")
    parts = ids.withColumn("r_run", F.col("r_id") - F.row_number().over(w)).groupBy(*by, "r_block", "r_run")
    parts = parts.agg(F.min("r_id").alias("run_start"), F.max("r_id").alias("run_end"), F.count(F.lit(1)).alias("n"), *low).drop("r_block", "r_run")
    at_edge = (F.pmod("run_start", F.lit(block)) == 0) | (F.pmod("run_end", F.lit(block)) == block - 1)
    along = Window.partitionBy(*by).orderBy("run_start")
    apart = F.coalesce(F.col("run_start") - F.lag("run_end").over(along) != 1, F.lit(True))
    edge = parts.where(at_edge).withColumn("r_new", apart.cast("int")).withColumn("r_run", F.sum("r_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.groupBy(*by, "r_run").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("n").alias("n"), *low).drop("r_run")
    return parts.where(~at_edge).unionByName(edge)


def related(e: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(label, key, hops): every node that ``start`` (label, key) reaches over at most ``hops`` edges of any relation, in either direction, with the least number of edges; the start itself is at 0.

    ``e`` has src_label, src, dst_label, dst. Frontier by frontier: a step joins the last frontier with the edges, and drops the nodes that an earlier one has.
    """
    both = e.select(F.struct(F.col("src_label").alias("label"), F.col("src").alias("key")).alias("a"), F.struct(F.col("dst_label").alias("label"), F.col("dst").alias("key")).alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    frontier = start.select(F.struct("label", "key").alias("b")).distinct()
    seen = frontier.withColumn("hops", F.lit(0))
    for i in range(1, hops + 1):
        # each frontier is read by the next step and by all later differences
        frontier = both.join(frontier.select(F.col("b").alias("f")), F.col("a") == F.col("f"), "left_semi").select("b").distinct().join(seen, "b", "left_anti").persist()
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(i)))
    return seen.select("b.label", "b.key", "hops")


def whole_nodes(found: DataFrame, nodes: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """``found`` (label, key and more) with ``node``, the properties of each node as a map of texts; nulls are left out. Nodes of labels without a table have none."""
    from functools import reduce

    props = lambda n: F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in n.columns]), F.array(*[F.col(f"`{c}`").cast("string") for c in n.columns])), lambda _, v: v.isNotNull())
    every = reduce(DataFrame.unionByName, [n.select(F.lit(l).alias("label"), F.col(keys[l]).cast("string").alias("key"), props(n).alias("node")) for l, n in nodes.items()])
    return found.join(every, ["label", "key"], "left")
