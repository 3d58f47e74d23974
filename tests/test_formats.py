"""Text formats both ways, instruction targets, name mining, scores and retrieval on small rows."""

from pyspark.sql import functions as F

from graphloom.operators import evaluation, formats, graph, instructions, mining, vectors

RELATIONS = [("a'b", "r_1", 'say "x"'), ("back\\slash", "r", "t")]


def test_round_trips(spark):
    d = spark.createDataFrame([(RELATIONS,)], "r array<struct<head:string,relation:string,tail:string>>")
    for style in range(4):
        for language in ("zh", "en"):
            text = formats.written(F.col("r"), "relation", style, language)
            got = d.select(formats.read_labels(text, "relation", language=language).alias("x")).first().x
            assert got.ok and got.labels == [list(r) for r in RELATIONS], (style, language)


def test_events_round_trip(spark):
    events = [("t", "T", [("a", "r"), ("", "empty"), ("b", "q")]), ("u", "U", []), ("", "V", []), ("w", "", [("x", "y")])]
    d = spark.createDataFrame([(events,)], "e array<struct<event_trigger:string,event_type:string,arguments:array<struct<argument:string,role:string>>>>")
    for style in range(4):
        for language in ("zh", "en"):
            text = d.select(formats.written_events(F.col("e"), style, language)).first()[0]
            assert formats.read(text, "event", language) == (True, [[["t", "T"], ["a", "r"], ["b", "q"]], [["u", "U"]]]), (style, text)


def test_written_corner_cases(spark):
    d = spark.createDataFrame([([("", "T")],), ([("x", "")],), ([],), ([("", "T"), ("x", "T")],), (None,)], "e array<struct<entity:string,entity_type:string>>")
    got = [r[0] for r in d.select(formats.written(F.col("e"), "entity", formats.TUPLE)).collect()]
    assert got[:4] == ["NAN", "NAN", "NAN", "NAN\n(x,T)"] and got[4] in (None, "NAN")


def test_read_corner_cases():
    assert formats.read(None, "entity") == (False, []) and formats.read("", "entity") == (True, []) == formats.read("No entity found.", "entity")
    assert formats.read("nonsense", "entity") == (False, [])
    assert formats.read("(a,b,T)", "entity") == (True, [["a,b", "T"]])
    assert formats.read("(a,b,r,t)", "relation", source="a,b and t") == (True, [["a,b", "r", "t"]])
    assert formats.read("(a,b,r,t)", "relation") == (False, [])
    assert formats.read("r：a,b,t", "relation", source="a,b t") == (True, [["a,b", "r", "t"]])
    assert formats.read("{'entity': 'x', 'entity_type': 'T',}", "entity") == (True, [["x", "T"]])
    assert formats.read("{'entity': __import__('os')}", "entity") == (False, [])


def test_targets(spark):
    events = [("later", "T", [("v", "r"), ("w", "r")]), ("first", "T", [("z", "other")])]
    d = spark.createDataFrame([(events, "first then later")], "e array<struct<event_trigger:string,event_type:string,arguments:array<struct<argument:string,role:string>>>>, t string")
    schema = F.array(F.struct(F.lit("T").alias("event_type"), F.array(F.lit("r"), F.lit("s")).alias("arguments")), F.struct(F.lit("U").alias("event_type"), F.array(F.lit("r")).alias("arguments")))
    got = d.select(instructions.event_target(F.col("e"), schema, F.col("t"))).first()[0]
    assert got == '{"T":[{"trigger":"first","arguments":{}},{"trigger":"later","arguments":{"r":["v","w"],"s":"NAN"}}],"U":[]}'
    d = spark.createDataFrame([([("h", "a", "2"), ("h", "a", "1"), ("g", "b", "3"), ("g", "no", "4")], "g 3 h 1 2")], "r array<struct<head:string,relation:string,tail:string>>, t string")
    assert d.select(instructions.attribute_target(F.col("r"), F.array(F.lit("a"), F.lit("b")), F.col("t"))).first()[0] == '{"g":{"b":"3"},"h":{"a":["1","2"]}}'


def test_negatives(spark):
    d = spark.createDataFrame([(1, [("T", [("r",)])]), (2, [])], "k int, e array<struct<event_type:string,arguments:array<struct<role:string>>>>")
    roles = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(y) for y in x]) for x in ("T", ["r", "s"], "U", ["q"], "V", ["p", "o"])])
    at = lambda rate: {r.k: {s.event_type: sorted(s.arguments) for s in r.s} for r in d.select("k", instructions.event_schemas(F.col("e"), roles, rate, rate, F.col("k")).alias("s")).collect()}
    assert at(0) == {1: {"T": ["r", "s"]}, 2: {}}
    assert at(1) == {1: {"T": ["r", "s"], "U": ["q"], "V": ["o", "p"]}, 2: {"T": ["r", "s"], "U": ["q"], "V": ["o", "p"]}}
    half = at(0.5)
    assert "r" in half[1]["T"] and len(half[2]) >= 1 and half == at(0.5)
    hard = spark.createDataFrame([("a", ["b", "c"])], "kind string, others array<string>")
    r = spark.createDataFrame([(1, ["a"]), (2, ["z"]), (3, [])], "k int, p array<string>")
    every = F.array(*[F.lit(x) for x in "abcdefz"])
    got = {x.k: x.schema for x in instructions.with_hard_negatives(r, "k", "p", hard, "kind", "others", every, 2).collect()}
    assert got[1][:3] == ["a", "b", "c"] and len(got[1]) == 5 and got[2][0] == "z" and len(got[2]) == 3 and len(got[3]) == 2


def test_ids_and_slices(spark):
    d = spark.createDataFrame([(f"text {i}",) for i in range(50)], "t string")
    a, b = instructions.template_ids(F.col("t"))
    got = d.select(a.alias("a"), b.alias("b")).collect()
    assert {r.a for r in got} <= set(range(20)) and {r.b for r in got} == {0, 1, 2, 3}
    rows = instructions.test_rows(d.limit(1), "t", F.array(*[F.lit(x) for x in "abcde"]), 2, "Find {schema}").collect()
    assert [(r.split, r.instruction) for r in rows] == [(0, 'Find ["a","b"]'), (1, 'Find ["c","d"]'), (2, 'Find ["e"]')]


def test_names(spark):
    d = spark.createDataFrame([("Armed Bio Site-19 and Area 51-b, site; 区域500米, 临时研究站-7, 站-3, 区域-12",), ("Site-CN-85-D",), ("",), (None,)], "s string")
    got = [r[0] for r in d.select(mining.places(F.col("s"))).collect()]
    assert got == [["Armed Bio Site-19", "Area 51-b", "临时研究站-7", "区域-12"], ["Site-CN-85-D"], [], None]
    d = spark.createDataFrame([("机动特遣队Nu-3 (“Limnophobia”), MTF-庚午-01-016, Mobile Task Force Epsilon-11 “Fox”",), ("Alpha 12 “x” and Beta-2",), ("none",), (None,)], "s string")
    got = [r[0] for r in d.select(mining.forces(F.col("s"), ["Alpha-1"])).collect()]
    assert got[0] == ["机动特遣队Nu-3 (“Limnophobia”)", "MTF-庚午-01", "Mobile Task Force Epsilon-11 “Fox”"]
    assert got[1] == ["Alpha 12 “x”"] and not got[2] and not got[3]


def test_scores(spark):
    d = spark.createDataFrame([("a b a", "a a c"), ("", "x"), (None, None)], "r string, c string")
    assert [r[0] for r in d.select(evaluation.rouge_n(F.col("r"), F.col("c"), 1)).collect()] == [2 / 3, 0.0, 0.0]
    assert [r[0] for r in d.select(evaluation.rouge_n(F.col("r"), F.col("c"), 2)).collect()] == [0.0, 0.0, 0.0]
    c = spark.createDataFrame([("s", 1, 2, 3)], "k string, tp long, gold long, pred long")
    assert tuple(evaluation.merged_counts([c, c], ["k"]).first()) == ("s", 2, 4, 6)
    m = spark.createDataFrame([({"h": {"r": ["x", "y"]}},)], "m map<string,map<string,array<string>>>")
    assert [tuple(x) for x in m.select(evaluation.attribute_triples(F.col("m"))).first()[0]] == [("h", "r", "x"), ("h", "r", "y")]


def test_expansion_and_chunks(spark):
    c = spark.createDataFrame([(i, "s" if i != 4 else "other", 100) for i in range(10)], "chunk_id long, source string, n_chars int")
    h = spark.createDataFrame([(2, "s", 0.5), (3, "s", 0.2), (9, "s", 0.9)], "chunk_id long, source string, score double")
    got = sorted(map(tuple, vectors.expanded(h, c, 200).select("source", "run_start", "run_end", "n", "score").collect()))
    assert got == [("s", 1, 3, 3, 0.2), ("s", 8, 9, 2, 0.9)]
    d = spark.createDataFrame([(["aa", "bb", "c" * 9, "d"],), ([],), (None,)], "s array<string>")
    assert [r[0] for r in d.select(vectors.packed_sentences(F.col("s"), 5)).collect()] == [["aa bb", "c" * 9, "d"], [], None]


def test_runs_over_block_edges(spark):
    import random

    draw = random.Random(3)
    ids = sorted({draw.randrange(-40, 60) for _ in range(80)})
    d = spark.createDataFrame([("g", i, float(abs(i))) for i in ids + ids[:5]] + [("h", 7, 1.0), ("g", None, 0.0)], "k string, v long, s double")
    want = []
    for i in ids:
        if want and want[-1][2] == i - 1:
            want[-1] = ("g", want[-1][1], i, want[-1][3] + 1, min(want[-1][4], abs(i)))
        else:
            want.append(("g", i, i, 1, float(abs(i))))
    for block in (1, 2, 7, 4096):
        got = graph.runs(d, ["k"], "v", "s", block).select("k", "run_start", "run_end", "n", "s").collect()
        assert sorted(map(tuple, got)) == sorted([*want, ("h", 7, 7, 1, 1.0)]), block
    assert graph.runs(d.limit(0), ["k"], "v").count() == 0
