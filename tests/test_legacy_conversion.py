"""The older conversion: placeholders, orders, templates and formats, from records and from files."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import legacy_conversion as O
from graphloom.operators.conversion import Schema

ENTITIES = "text string, entity array<struct<entity:string,entity_type:string>>"
RELATIONS = "text string, relation array<struct<head:string,relation:string,tail:string>>"
EVENTS = "text string, event array<struct<event_trigger:string,event_type:string,arguments:array<struct<argument:string,role:string>>>>"
T = "{s_format}|{s_schema}"


def rows(df):
    return {r.input: (*r.instruction.split("|", 1), r.output) for r in df.collect()}


def test_placeholders_and_schema(spark):
    d = spark.createDataFrame([("Ann in Rome", [("Ann", "person"), ("Rome", "place")]), ("none", None)], ENTITIES)
    got = rows(O.converted(d, "NER", [T], Schema(("person", "place", "law", "org")), 0, 1, 1, "en", False))
    assert got["Ann in Rome"] == ("(Entity,Entity Type)\n", "['law', 'org', 'person', 'place']", "(Ann,person)\n(Rome,place)\nNAN\nNAN")
    assert got["none"][1:] == ("['law', 'org', 'person', 'place']", "NAN")
    got = rows(O.converted(d, "NER", [T], None, 0, 0, 1, "en", False))
    assert got["Ann in Rome"][1] == "['person', 'place']" and got["none"][1:] == ("[]", "NAN")
    r = spark.createDataFrame([("a b", [("a", "r1", "b")])], RELATIONS)
    assert rows(O.converted(r, "RE", [T] * 4, Schema(roles=("r1", "it's")), 3, 1, 1, "zh", False))["a b"][1:] == ("[\"it's\", 'r1']", "{'head': 'a', 'relation': 'r1', 'tail': 'b'}\nNAN")


def test_event_placeholders(spark):
    e = spark.createDataFrame([("won it", [("won", "win", [("it", "what")]), ("", "win", [])])], EVENTS)
    s = Schema(("lose", "win"), (), (("lose", ("who",)), ("win", ("what", "when", "who"))))
    kept = e.select(O.with_negatives("EE", O.plain(O.TASKS["EE"], F.col("event")), s, 0, F.lit(1), 7).alias("e")).first()["e"]
    assert [(x.event_trigger, x.event_type) for x in kept] == [("won", "win"), ("", "win"), ("", "lose")]
    assert [sorted((a.role, a.argument) for a in x.arguments) for x in kept] == [[("what", "it"), ("when", ""), ("who", "")], [], [("who", "")]]
    for seed in range(30):  # drawn roles: one at least, none twice, none that the type's events have
        kept = e.select(O.with_negatives("EE", O.plain(O.TASKS["EE"], F.col("event")), s, 1, F.lit(1), seed).alias("e")).first()["e"] if seed < 6 else kept
        roles = [a.role for x in kept if x.event_type == "win" for a in x.arguments]
        assert len(roles) == len(set(roles)) and set(roles) <= {"what", "when", "who"}
    got = rows(O.converted(e, "EE", [T], s, 0, 1, 1, "en", False))["won it"]
    assert got[1].startswith("{'lose': ['who'], 'win': ['what'") and got[2].startswith("(won,win,what#it")
    assert rows(O.converted(e, "EEA", ["{s_format}|{s_schema1}{s_schema2}"], s, 0, 1, 1, "en", False))["won it"][1] == "{'win': ['what']}[{'event_type': 'win', 'event_trigger': ''}, {'event_type': 'win', 'event_trigger': 'won'}]"


def test_orders(spark):
    d = spark.createDataFrame([("c b a", [("a", "r1", "b"), ("c", "r2", "a"), ("b", "r1", "c"), ("zz", "r1", "c")])], RELATIONS)
    seen = set()
    for seed in range(12):
        got = d.select(O.in_random_order("RE", O.plain(O.TASKS["RE"], F.col("relation")), F.col("text"), F.lit(1), seed).alias("r"), O.schema_text("RE", F.col("relation"), F.lit(1), True, seed).alias("s")).first()
        names = [x.relation for x in got.r]
        assert [x.head for x in got.r if x.relation == "r1"] == ["zz", "b", "a"]  # nowhere first, then by place
        assert list(dict.fromkeys(names)) == [x.strip("'") for x in got.s[1:-1].split(", ")] and len(list(dict.fromkeys(names))) == 2
        seen.add(tuple(dict.fromkeys(names)))
    assert len(seen) == 2
    e = spark.createDataFrame([("x y z", [("z", "T", [("y", "r"), ("x", "r"), ("", "s")]), ("x", "T", [])])], EVENTS)
    got = e.select(O.in_random_order("EE", O.plain(O.TASKS["EE"], F.col("event")), F.col("text"), F.lit(1), 3).alias("e")).first()["e"]
    assert [x.event_trigger for x in got] == ["x", "z"] and [a.argument for a in got[1].arguments if a.role == "r"] == ["x", "y"]


def test_draws(spark):
    d = spark.createDataFrame([(f"text {i}", [("e", "t0")]) for i in range(2000)], ENTITIES)
    s = Schema(tuple(f"t{i}" for i in range(10)))
    made = O.converted(d, "NER", [f"{i}|{T}" for i in range(20)], s, neg_ratio=0.3, neg_schema=0.5, language="en")
    got = made.collect()
    parts = [r.instruction.split("|") for r in got]
    assert {p[0] for p in parts} == {str(i) for i in range(20)} and {p[1] for p in parts} == set(O.SHOWN["entity", "en"])
    assert len({(p[0], p[1]) for p in parts}) == 80  # the format doesn't follow from the template
    sizes = [p[2].count("'t") for p in parts]
    grown = [n for n in sizes if n > 1]
    assert 0.26 < len(grown) / 2000 < 0.34 and set(grown) <= {5, 6}
    assert sorted(map(tuple, made.repartition(7).collect())) == sorted(map(tuple, got)) and got[0].id and all(("e" in r.output) for r in got)


def test_bad_numbers(spark):
    d = spark.createDataFrame([("t", [("e", "t0")])], ENTITIES)
    for sample, n in ((4, 20), (2, 2), (-2, 3), (-1, 0)):
        with pytest.raises(ValueError):
            O.converted(d, "NER", [T] * n, sample=sample)
    assert O.converted(d.limit(0), "NER", [T]).count() == 0



def test_marks_are_replaced_once(spark):
    d = spark.createDataFrame([("t", [("e", "{s_format}")])], ENTITIES)
    assert O.converted(d, "NER", ["a {s_schema} b {s_format} c {s_schema} {x}"], sample=0, neg_ratio=0, language="en").first().instruction == "a ['{s_format}'] b (Entity,Entity Type)\n c ['{s_format}'] {x}"


def test_from_file_to_file(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps({"text": "Ann", "entity": [{"entity": "Ann", "entity_type": "person"}]}) + "\n")
    (tmp_path / "t.json").write_text(json.dumps({"en": {"template": {str(i): f"{i}: {T}" for i in range(20)}, "open_template": {}}, "zh": {"template": {"0": "x"}, "open_template": {}}}))
    O.convert_file(spark, "NER", str(tmp_path / "in.json"), str(tmp_path / "out"), str(tmp_path / "t.json"), language="en", sample=2)
    (r,) = spark.read.json(str(tmp_path / "out")).collect()
    assert r.instruction == "2: Entity Type：Entity\n|['person']" and r.output == "person：Ann" and r.input == "Ann"
