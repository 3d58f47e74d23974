"""HTML, mining, text formats, model hooks and output parsing on small rows."""

from pyspark.sql import functions as F

from graphloom.functions import html as H
from graphloom.operators import evaluation, legacy, mining, models

PAGE = """<html><head><style>.box { border: solid 1px; } .flat { border: 0 }</style></head><body>
<div class="page-tags"><span><a href="t1">b</a><a href="t2">a</a></span></div>
<div id="page-content"><a href="top.html">direct</a><h1>One</h1><p>x <a href="a.html">A</a><p>y <a href="b.html">B</a> <a href="c.pdf">C</a>
<div style="display: none">gone <a href="gone.html">g</a></div><span style="text-decoration: line-through">struck</span>
<h2>Two</h2><div><div>inner</div></div><table><tr><td>1</td><td>2
3</td></tr></table><p>after</p><div class="colmod-block"><div class="colmod-content">open</div><div class="colmod-content">other</div></div><p></p></div>"""


def test_page():
    p = H.page(PAGE)
    assert p["tags"] == ["a", "b"]
    assert p["links"] == [{"link": "b", "text": "B"}, {"link": "a", "text": "A"}]
    assert "gone" not in p["text"] and "struck" not in p["text"]
    assert p["blocks"][0].startswith("direct") and p["blocks"][1].startswith("One\nx A\ny B C")
    assert "【1|2; 3】" in p["blocks"] and p["blocks"][-1] == "after\nopen"
    assert H.page(None) == H.page("") == {"tags": [], "links": [], "blocks": [], "text": ""}


def test_page_corner_cases():
    assert H.bordered(H.parse(PAGE)) == {".box"} and H.bordered(H.parse("")) == {".alt-block"}
    assert H.page('<div id="page-content"><h1>:</h1><h1>next</h1></div>')["blocks"] == [":next"]
    assert H.page("<p>a</i></b><p>b" + "<div>" * 5000 + "deep")["text"] == "abdeep"
    assert H.page("<ul><li>a<li>b</ul>")["text"] == "ab"


def test_parsed(spark):
    rows = spark.createDataFrame([(PAGE,), (None,)], "html string").select(H.parsed(F.col("html")).alias("p")).select("p.*").collect()
    assert [r.tags for r in rows] == [["a", "b"], []] and rows[0].links[0].link == "b"


def test_mining(spark):
    d = spark.createDataFrame([("Site-1 and Site-2",), ("Site-1",), ("Site-1",), ("none",), (None,)], "s string")
    m = mining.matches(d, "s", r"Site-\d", "site")
    assert {r.text for r in m.collect()} == {"Site-1 and Site-2", "Site-1"}
    both = m.unionByName(mining.matches(d, "s", "and", "word"))
    assert {r.entity for r in mining.entities(both).collect()} == {"Site-1", "Site-2", "and"}
    r = mining.ranked(both, ["site", "word"], 5).collect()
    assert [(x.text, x.entity_type_count, x.frequency, x.entities) for x in r] == [("Site-1 and Site-2", 2, 2, 3), ("Site-1", 1, 2, 1)]
    assert mining.ranked(both.limit(0), ["site"], 5).count() == 0


def test_ranked_matches(spark, monkeypatch):
    """As a plain version ranks them, also beyond the entities that tasks hold and where texts share their heads; no text is dealt whole."""
    import random
    import re
    from collections import Counter

    monkeypatch.setattr(mining, "HEAD", 3)
    monkeypatch.setattr(mining, "OFTEN", 2)
    r, kinds = random.Random(3), {"x": "X[a-c]", "y": "Y[a-e]+"}
    texts = [" ".join(r.choice(["Xa", "Xb", "Xc", "Ya", "Yab", "Yde", "n"]) for _ in range(r.randint(0, 4))) for _ in range(200)] + [None]
    found = {t: [e for e in (re.findall(p, t) for p in kinds.values())] for t in texts if t}
    found = {t: f for t, f in found.items() if any(f)}
    often = Counter(e for f in found.values() for k in f for e in k)
    fact = {t: (sum(map(bool, f)), max(often[e] for k in f for e in k), sum(map(len, f))) for t, f in found.items()}
    want = sorted(found, key=lambda t: (-fact[t][0], fact[t][1], -fact[t][2], 1 if found[t][0] else 2, max(len(e) for k in found[t] for e in k), t))
    d = spark.createDataFrame([(t,) for t in texts], "s string").repartition(3)
    both = mining.matches(d, "s", kinds["x"], "x").unionByName(mining.matches(d, "s", kinds["y"], "y"))
    for n in (7, 1000):
        q = mining.ranked_matches(d, "s", kinds, n)
        got = [(x.text, (x.entity_type_count, x.frequency, x.entities)) for x in q.collect()]
        assert got == [(t, fact[t]) for t in want[:n]] and [x.text for x in mining.ranked(both, list(kinds), n).collect()] == want[:n]
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan and plan.count("RepartitionByExpression") == plan.count("RepartitionByExpression [id")


def test_few_shot(spark):
    d = spark.createDataFrame([("i", "a", "x"), ("i", "a", "y"), ("j", "b", "z")], "input string, entity string, output string")
    out = {r.input: r.output for r in mining.few_shot(d, "input", "entity", "output", ["a", "b"]).collect()}
    assert out == {"i": {"a": ["x", "y"], "b": []}, "j": {"a": [], "b": ["z"]}}


def test_contained_or_related(spark):
    d = spark.createDataFrame([("f", 0, "scp-1", False), ("f", 1, None, True), ("f", 2, "scp-2", None), ("f", 3, "doc", False)], "f string, pos int, link string, m boolean")
    r = mining.contained_or_related(d, "f", "pos", F.col("m"), "scp-", "link").first()
    assert (r.contained, r.related) == (["scp-2"], ["scp-1"])


def test_text_formats(spark):
    d = spark.createDataFrame([("ab in xy", [("xy", "T"), ("ab", "T")]), ("", [])], "text string, l array<struct<entity:string,type:string>>")
    l = legacy.with_placeholders(F.col("l"), F.array(F.lit("U")), "entity", "type")
    rows = d.select(legacy.tuples(l, "entity", "type").alias("t"), F.size(l).alias("n"), legacy.random_order(F.col("l"), F.col("text"), "entity", "type")["entity"].alias("o")).collect()
    assert [tuple(r) for r in rows] == [("(xy,T)\n(ab,T)", 3, ["ab", "xy"]), ("NAN", 1, [])]
    back = d.select(legacy.untupled(legacy.tuples(F.col("l"), "entity", "type"), 2).alias("b")).collect()
    assert [r.b for r in back] == [[["xy", "T"], ["ab", "T"]], []]
    assert legacy.schema_of(d, "l", "type").first().types == ["T"]


def test_models(spark):
    turns = spark.createDataFrame([([("q", "a"), ("r", None)],)], "t array<struct<query:string,answer:string>>")
    assert turns.select(models.rendered(F.col("t"), "U:{query}\n", "A:{answer}\n", "S\n").alias("x")).first().x == "S\nU:q\nA:a\nU:r\n"
    r = spark.createDataFrame([([1, 2, 3, 4, 5, 6], [7, 8, 9])], "p array<int>, a array<int>").select(models.supervised(F.col("p"), F.col("a"), 6).alias("s")).first().s
    assert (r.input_ids, r.labels) == ([1, 2, 3, 4, 7, 8], [-100] * 4 + [7, 8])
    d = spark.createDataFrame([(1, "x", "old"), (2, None, None)], "k int, prompt string, output string")
    got = models.infer(d, "prompt", lambda: lambda batch: [x.upper() for x in batch]).collect()
    assert sorted((x.k, x.prompt, x.output) for x in got) == [(1, "x", "X"), (2, None, "")] and got[0].__fields__ == ["k", "prompt", "output"]


def test_model_output(spark):
    d = spark.createDataFrame([('{"A": ["x", 1, "y"], "B": "z"}',), ("[1]",), ("{",), (None,)], "o string")
    rows = d.select(evaluation.typed_values(F.col("o")).alias("v")).select("v.*").collect()
    assert [r.ok for r in rows] == [True, False, False, False] and [tuple(i) for i in rows[0]["items"]] == [("A", "x"), ("A", "y")]
    c = spark.createDataFrame([("s", 1, ["b"], "l2"), ("s", 0, ["a"], "l1")], "source string, pos int, found array<string>, label string")
    assert tuple(evaluation.joined_chunks(c, ["source"], "pos", "found", "label").first()) == ("s", ["a", "b"], "l1")
    e = spark.createDataFrame([([("t", "g", [("a", "r")])],)], "e array<struct<event_type:string,event_trigger:string,arguments:array<struct<argument:string,role:string>>>>")
    whole, parts = evaluation.event_items(F.col("e"))
    r = e.select(whole.alias("w"), parts.alias("p")).first()
    assert [tuple(x) for x in r.w] == [("t", "g")] and [tuple(x) for x in r.p] == [("t", "a", "r")]


def test_top_k_batch_in_blocks(spark):
    from graphloom.operators import vectors

    rows = [(i, [float(i * 37 % 101), float(i * 53 % 97)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.top_k_batch(df, df.where("vec_id % 2 = 0"), 3, most_queries=15).collect()
    want = set()
    for q, a in rows[::2]:
        near = sorted((((a[0] - x[0]) ** 2 + (a[1] - x[1]) ** 2) ** 0.5, v) for v, x in rows)[:3]
        want |= {(q, v, r + 1) for r, (_, v) in enumerate(near)}
    assert len(got) == len(want) and {(x.query_id, x.vec_id, x["rank"]) for x in got} == want
