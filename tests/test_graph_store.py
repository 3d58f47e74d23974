"""The whole graph, nodes that are related, and the bucketed store."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import build, graph as G
from graphloom.sources import graph_store

EDGES = "src_label string, src string, rel string, dst_label string, dst string"


def nodes_of(spark):
    tags = lambda *x: spark.createDataFrame([(f"n{t}", t) for t in x], "name string, tag string")
    objects = spark.createDataFrame([("1", ["a", "b", "a", None]), ("2", []), ("3", None), ("4", ["c", "z"])], "item string, tag_list array<string>")
    sources = {"SCP": objects, "Tag": spark.createDataFrame([("a", "A"), ("b", "B")], "tag string, english string"), "Canon": tags("a", "q", None), "Series": spark.createDataFrame([("s1", "b"), ("s2", "b")], "name string, tag string")}
    held = spark.createDataFrame([("f1", 1, ["1", "2", "9"]), ("f0", 2, ["2", "4"]), ("f2", 0, None)], "name string, place int, items array<string>")
    return sources, held


def test_whole_build(spark):
    sources, held = nodes_of(spark)
    keys = {"SCP": "item", "Canon": "name", "Series": "name"}
    nodes, e = build.built_graph(sources, keys, facilities=build.Holders(held, "name", "items", "place"), forces=build.Holders(held, "name", "items"))
    assert list(nodes) == ["Tag", "Canon", "Series", "SCP"]
    assert sorted((r.tag, r.english) for r in nodes["Tag"].collect()) == [("a", "A"), ("b", "B"), ("c", None), ("q", None), ("z", None)]
    assert sorted(map(tuple, e.select(*build.EDGE).collect())) == sorted([
        ("Tag", "a", "IS_TAG_OF", "Canon", "na", 1), ("Tag", "q", "IS_TAG_OF", "Canon", "nq", 1), ("Tag", "b", "IS_TAG_OF", "Series", "s1", 2), ("Tag", "b", "IS_TAG_OF", "Series", "s2", 2),
        ("SCP", "1", "HAS_TAG", "Tag", "a", 1), ("SCP", "1", "HAS_TAG", "Tag", "b", 1), ("SCP", "4", "HAS_TAG", "Tag", "c", 1), ("SCP", "4", "HAS_TAG", "Tag", "z", 1),
        ("SCP", "1", "BELONG_T0_CANON", "Canon", "na", 1), ("SCP", "1", "BELONG_T0_SERIES", "Series", "s1", 1), ("SCP", "1", "BELONG_T0_SERIES", "Series", "s2", 1),
        ("SCP", "1", "IS_CONTAINED_IN_FACILITY", "Facility", "f1", 1), ("SCP", "2", "IS_CONTAINED_IN_FACILITY", "Facility", "f1", 1), ("SCP", "4", "IS_CONTAINED_IN_FACILITY", "Facility", "f0", 1),
        ("SCP", "1", "IS_CONTAINED_BY_TASKFORCE", "TaskForce", "f1", 1), ("SCP", "2", "IS_CONTAINED_BY_TASKFORCE", "TaskForce", "f1", 1), ("SCP", "2", "IS_CONTAINED_BY_TASKFORCE", "TaskForce", "f0", 1), ("SCP", "4", "IS_CONTAINED_BY_TASKFORCE", "TaskForce", "f0", 1),
    ])


def test_related(spark):
    e = spark.createDataFrame([("A", "1", "x", "B", "1"), ("B", "1", "y", "C", "9"), ("C", "9", "y", "C", "8"), ("C", "8", "z", "A", "1"), ("C", "8", "z", "C", "8"), ("D", "5", "z", "D", "6")], EDGES)
    start = spark.createDataFrame([("A", "1"), ("A", "1"), ("E", "0")], "label string, key string")
    got = lambda k: sorted(map(tuple, G.related(e, start, k).collect()))
    assert got(0) == [("A", "1", 0), ("E", "0", 0)]
    assert got(1) == [("A", "1", 0), ("B", "1", 1), ("C", "8", 1), ("E", "0", 0)]
    assert got(4) == [("A", "1", 0), ("B", "1", 1), ("C", "8", 1), ("C", "9", 2), ("E", "0", 0)]
    nodes = {"A": spark.createDataFrame([("1", 5, None)], "k string, n int, x string"), "C": spark.createDataFrame([(8,), (9,)], "c long")}
    found = {(r.label, r.key): r.node for r in G.whole_nodes(G.related(e, start, 4), nodes, {"A": "k", "C": "c"}).collect()}
    assert found == {("A", "1"): {"k": "1", "n": "5"}, ("B", "1"): None, ("C", "8"): {"c": "8"}, ("C", "9"): {"c": "9"}, ("E", "0"): None}


@pytest.fixture
def store(spark, tmp_path):
    people = spark.createDataFrame([(str(i), f"p{i}") for i in range(200)], "id string, name string")
    towns = spark.createDataFrame([(str(i), f"t{i}") for i in range(20)], "id string, name string")
    e = spark.createDataFrame([(str(i), "LIVES_IN", str(i % 20)) for i in range(200)] + [(str(i), "KNOWS", str((i * 7) % 200)) for i in range(200)], "src string, rel string, dst string")
    path = str(tmp_path / "graph")
    graph_store.write_buckets({"Person": people, "Town": towns, "Note": towns}, {"Person": "id", "Town": "id"}, e, path, 6)
    return graph_store.open_buckets(spark, path), e, people, towns


def scans_behind_exchanges(df):
    """The names of the tables that an exchange of the plan reads without a join in between."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(re.sub(r"^[\s:+|-]*", "", line))
    found = []
    for i, line in enumerate(plan):
        if "Scan parquet" in line:
            at = depth(line)
            for above in reversed(plan[:i]):
                if depth(above) < at:
                    at = depth(above)
                    if "Join" in above:
                        break
                    if "Exchange" in above:
                        found.append(re.search(r"Scan parquet (\S+)", line)[1])
                        break
    return found


def test_store_round_trip(spark, store):
    g, e, people, towns = store
    assert sorted(g.out.collect()) == sorted(g.back.collect()) == sorted(e.collect())
    assert sorted(g.nodes["Person"].collect()) == sorted(people.collect()) and sorted(g.nodes["Note"].collect()) == sorted(towns.collect())
    assert g.edges("KNOWS").count() == 200 and g.edges(back=True).count() == 400
    with pytest.raises(FileNotFoundError):
        graph_store.open_buckets(spark, "/tmp/no/graph/here")


def test_two_hops_deal_no_stored_table_anew(spark, store):
    g, e, people, towns = store
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "6")):
        spark.conf.set(k, v)
    try:
        p = G.Pattern(g.nodes["Person"], "a").out(g.edges("KNOWS"), "id", g.nodes["Person"], "b", "id").out(g.edges("LIVES_IN"), "id", g.nodes["Town"], "t", "id")
        out = p.returns(F.col("a.name").alias("a"), F.col("b.name").alias("b"), F.col("t.name").alias("t"))
        assert scans_behind_exchanges(out) == []
        assert sorted(map(tuple, out.collect())) == sorted((f"p{i}", f"p{i * 7 % 200}", f"t{i * 7 % 200 % 20}") for i in range(200))
        back = G.Pattern(g.nodes["Town"], "t").out(g.edges("LIVES_IN", back=True), "id", g.nodes["Person"], "b", "id", back=True).returns(F.col("t.name").alias("t"), F.col("b.name").alias("b"))
        assert scans_behind_exchanges(back) == [] and back.count() == 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_node_gathers_its_objects(spark):
    """Holders of one object a row give the edges of those of arrays, and the query's plan gathers no list of a nation's parts."""
    from graphloom.plans import registry

    objects = spark.createDataFrame([(1,), (2,), (3,)], "item int")
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 2), ("a", None), (None, 9)], "name string, items int")
    lists = spark.createDataFrame([("a", [1, None]), ("b", [1, 2, 2]), (None, [9])], "name string, items array<int>")
    for first in (False, True):
        of = lambda h: sorted(tuple(r) for r in build.contained(objects, "item", build.Holders(h, "name", "items"), "IN", first).collect())  # noqa: B023, E731
        assert of(rows) == of(lists) == [("1", "IN", "a"), *([] if first else [("1", "IN", "b")]), ("2", "IN", "b")]
    plan = registry.QUERIES["graph_whole_build"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan
