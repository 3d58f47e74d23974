"""Data sets by their ending, graphs removed and described, nodes merged, elements by selector."""

import json

from pyspark.sql import functions as F

from graphloom.functions import html as H, text as X
from graphloom.operators import conversion as C, graph as G, instructions as I
from graphloom.sources import files as S


def test_dataset_rename_and_split(spark, tmp_path):
    rows = [{"instruction": f"q{i}", "output": f"a{i}", "id": i, "response": "old"} for i in range(40)]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "d.csv").write_text("id,instruction\n1,x\n")
    d = S.dataset(spark, str(tmp_path / "d.json"), renames={"instruction": "prompt", "output": "response", "none": "z"})
    assert sorted(d.columns) == ["id", "prompt", "response"] and d.where("response = 'old'").isEmpty()
    assert S.dataset(spark, str(tmp_path / "d.csv"), renames={"instruction": "prompt"}).first().prompt == "x"
    d.write.parquet(str(tmp_path / "p"))
    train, test = I.split(S.dataset(spark, str(tmp_path / "p")), "id", 0.1)
    assert (train.count(), test.count()) == (36, 4) and train.join(test, "id").isEmpty()
    assert S.dataset(spark, str(tmp_path / "d.json"), "id long").columns == ["id"]


def test_graph_is_removed(spark, tmp_path):
    path = str(tmp_path / "g")
    S.write_graph({"A": spark.range(3)}, spark.createDataFrame([("1", "r", "2")], "src string, rel string, dst string"), path)
    assert S.exists(spark, path)
    S.delete_graph(spark, path)
    S.delete_graph(spark, path)
    assert not S.exists(spark, path)


def test_nodes_and_schema(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (None, None)], "id int, name string")
    assert sorted(map(str, G.create_nodes(a, b).collect())) == sorted(map(str, a.collect() + b.collect()))
    assert sorted(r.id for r in G.create_nodes(a, b, merge=True).collect()) == [1, 2]
    assert {(r.id, r.more) for r in G.create_nodes(a, spark.createDataFrame([(3, 4)], "id int, more int")).collect()} == {(1, None), (3, 4)}
    e = spark.createDataFrame([("1", "r", "2"), ("2", "r", "3"), ("2", "s", "3")], "src string, rel string, dst string")
    labels, rels = G.schema_text({"A": a}, e)
    assert labels == {"A": "struct<id:int,name:string>"} and sorted(r.rel for r in rels.collect()) == ["r", "s"]


def test_selected(spark):
    d = spark.createDataFrame([('<div class="x"> a <b>b</b><a href="u">l</a><a href="v"></a></div><a class="x" href="w">t</a><div class="y">n</div>',), (None,)], "h string")
    got = [[tuple(x) for x in r[0]] for r in d.select(H.selected(F.col("h"), "div.x")).collect()]
    assert got == [[("a bl", "u")], []]
    assert [tuple(x) for x in d.select(H.selected(F.col("h"), "a.x")).first()[0]] == [("t", "w")]


def test_small_text_functions(spark):
    d = spark.createDataFrame([(3.0, 0.0, " A b "), (1.0, 3.0, None)], "a double, b double, t string")
    assert [tuple(r) for r in d.select(X.safe_ratio(F.col("a"), F.col("b")), X.lowered(F.col("t"))).collect()] == [(0.0, "a b"), (0.33, None)]
    d = spark.createDataFrame([("Alpha-1",), ("beta",), (None,)], "t string")
    assert [r[0] for r in d.select(X.type_by_name(F.col("t"), {"alpha": "A", "al": "B"})).collect()] == ["A", None, None]
    d = spark.createDataFrame([(".a > .b, .c",)], "t string")
    assert d.select(X.split_selectors(F.col("t"))).first()[0] == [".a > .b", ".c"]
    d = spark.createDataFrame([("h_r_s_t",)], "t string")
    assert d.select(X.triple_text(*[X.triple_of(F.col("t"))[k] for k in ("head", "relation", "tail")])).first()[0] == "h_r_s_t"
    assert X.alternation(["a", "a.b", "c"]) == "a\\.b|a|c"


def test_vocabularies(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"genre": {"a": "A", "b": "B"}, "none": {}}')
    assert sorted(map(tuple, S.vocabulary_file(spark, str(tmp_path / "v.json")).collect())) == [("genre", "a", "A"), ("genre", "b", "B")]
    (tmp_path / "t.json").write_text('{"person": ["spouse", "work", "spouse"], "city": ["age"], "x": null}')
    t = S.topic_file(spark, str(tmp_path / "t.json"))
    assert sorted((r.topic, r.relations) for r in t.collect()) == [("city", ["age"]), ("person", ["spouse", "work"]), ("x", [])]
    s = C.Schema.of_topics(t.collect())
    assert s == C.Schema(("city", "person", "x"), ("age", "spouse", "work"), (("city", ("age",)), ("person", ("spouse", "work")), ("x", ())))
    d = spark.createDataFrame([("Ann", [("Ann", "spouse", "Bob")])], "text string, relation array<struct<head:string,relation:string,tail:string>>")
    assert any('"spouse":"Bob"' in r.output for r in C.converted(d, "KG", s, "x", 1).collect())
    for f in (S.vocabulary_file, S.topic_file):
        assert f(spark, str(tmp_path / "no.json")).count() == 0


def test_selected_as_written(spark):
    """Character references and cut ones stay as the page has them."""
    d = spark.createDataFrame([('<h1> a &amp; b &quot;c&amp</h1><a href="x?a&amp;b">l</a>',), (None,)], "h string")
    s = d.select(H.selected(F.col("h"), "h1", written=True).alias("h"), H.selected(F.col("h"), "a", written=True).alias("a"), H.selected(F.col("h"), "h1").alias("d")).collect()
    assert (s[0].h[0].text, s[0].a[0].href, s[0].d[0].text) == ("a &amp; b &quot;c&amp", "x?a&amp;b", 'a & b "c&') and s[1].h == []


def test_slices(spark):
    """Batches are answered in slices of bounded rows and characters, in order and whole."""
    import pandas as pd

    from graphloom.functions import slices as S
    from graphloom.functions.sentences import split_sentences

    s = pd.Series(["aaa", None, "b", "cccccc", "", "d"])
    assert [list(x) for x in S.slices(s, S.characters, 4, 3)] == [["aaa", None, "b"], ["cccccc"], ["", "d"]] and [len(x) for x in S.slices(s[:0], S.characters)] == [0]
    rows = [(i, f"a{i}.b." if i % 3 else None) for i in range(1000)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string").select("i", split_sentences(F.col("t"), ".").alias("s")).collect()}
    assert got == {i: [f"a{i}.", "b."] if t else [] for i, t in rows}
