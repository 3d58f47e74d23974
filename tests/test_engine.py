"""Queries against DuckDB at sf0.001, and units of the functions."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.sentences import sentences
from graphloom.operators import evaluation, graph, instructions
from graphloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([r[n] for n in names]) for r in df.collect())
    cur = duck.execute(registry.ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == names
    assert got == sorted(repr([dict(zip(cols, r))[n] for n in names]) for r in cur.fetchall())


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


def test_scalars(spark):
    assert one(spark, "http://x.wikidot.com/../a-b.html#t", X.strip_address) == "a-b"
    assert one(spark, None, X.strip_address) is None
    assert one(spark, "system_page-tags/tag/a%20b+c.html", X.strip_tag) == "a b+c"
    assert one(spark, "tag/a", X.strip_tag) is None
    assert one(spark, '"x"', X.strip_quote) == "x" and one(spark, "", X.strip_quote) == ""
    assert one(spark, 'a "b" c "d"', X.split_quote) == ["b", "d"]
    assert one(spark, "Site-007-b", X.unify_name) == "site-007-b" and one(spark, "Site-07", X.unify_name) == "site-7"
    assert one(spark, "The  cat, an owl!", X.normalize_answer) == "cat owl"
    assert one(spark, "h_r_s_t", lambda c: X.triple_of(c)).asDict() == {"head": "h", "relation": "r_s", "tail": "t"}
    assert one(spark, ["ab", "abc", "x"], X.substring_eliminated, "array<string>") == ["abc", "x"]


def test_sentences():
    assert sentences("一。二！？三") == ["一。", "二！？", "三"]
    assert sentences("他说“好。走。”然后。") == ["他说“好。走。”然后。"]
    assert sentences(None) == [] and sentences("a\n\nb") == ["a", "b"]


@pytest.mark.parametrize("n,by,sizes", [(49, 4, [4] * 11 + [5]), (65, 4, [4] * 15 + [5]), (3, 6, [3]), (15, 1, [1] * 15), (65, -1, [65]), (6, 4, [4, 2])])
def test_chunks(spark, n, by, sizes):
    got = spark.range(1).select(instructions.chunks(F.sequence(F.lit(1), F.lit(n)), by).alias("c")).first()[0]
    assert [len(x) for x in got] == sizes and sum(got, []) == list(range(1, n + 1))


def test_split_is_exact_and_disjoint(spark):
    train, test = instructions.split(spark.range(200).select(F.col("id").alias("k")), "k")
    a, b = {r.k for r in train.collect()}, {r.k for r in test.collect()}
    assert len(b) == 10 and not a & b and len(a | b) == 200


def test_scores(spark):
    d = spark.createDataFrame([("s", 1, "a"), ("s", 1, "a"), ("s", 2, "b")], "source string, id int, item string")
    c = evaluation.counts(d, d, ["source", "id"], "item")
    assert {(r.tp, r.gold, r.pred) for r in c.collect()} == {(2, 2, 2), (1, 1, 1)}
    assert {r.f1 for r in evaluation.totals(c, ["source"]).collect()} == {100.0}
    assert evaluation.lcs("abcd", "acxd") == 3


def test_edges(spark):
    heads = spark.createDataFrame([("t", ["a", "b", "z"])], "h string, v array<string>")
    tails = spark.createDataFrame([("a",), ("b",)], "k string")
    assert {(r.src, r.dst) for r in graph.edges(heads, "h", F.col("v"), tails, "k", "R").collect()} == {("t", "a"), ("t", "b")}


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
