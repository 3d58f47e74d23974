"""Conversion, the graph end to end, readers of model output, sources."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions.sentences import sentences
from graphloom.operators import build, conversion as C, evaluation as M, graph as G, instructions as I, vectors as V
from graphloom.sources import files as S

EVENTS = "text string, event array<struct<event_trigger:string,event_type:string,arguments:array<struct<argument:string,role:string>>>>"
RELATIONS = "text string, relation array<struct<head:string,relation:string,tail:string,head_type:string,tail_type:string>>"


def test_train_rows_have_a_key_for_each_item(spark):
    d = spark.createDataFrame([("Ann met Bob in Rome", [("Ann", "person"), ("Bob", "person"), ("Rome", "place")]), ("nothing", [])], "text string, entity array<struct<entity:string,entity_type:string>>")
    s = C.Schema(("person", "place", "org", "date", "law"))
    rows = C.converted(d, "NER", s, C.source_of("/x/news/train.json"), 4, language="en").collect()
    found = {}
    for r in rows:
        said, out = json.loads(r.instruction), json.loads(r.output)
        assert r.task == "NER" and r.source == "news" and list(out) == said["schema"] and said["instruction"] == C.INSTRUCTIONS["NER", "en"]
        found.setdefault(said["input"], {}).update(out)
    assert {k: sorted(v) for k, v in found.items()} == {t: sorted(s.types) for t in ("Ann met Bob in Rome", "nothing")}
    assert found["Ann met Bob in Rome"]["person"] == ["Ann", "Bob"] and found["Ann met Bob in Rome"]["law"] == [] and not any(found["nothing"].values())
    assert C.converted(d, "NER", C.Schema(), "x", 4).count() == 0 and C.converted(d.limit(0), "NER", s, "x", 4).count() == 0


def test_test_rows(spark):
    d = spark.createDataFrame([("a", [("x", "r1", "y", "P", "Q")]), ("b", None)], RELATIONS)
    rows = C.converted(d, "RE", C.Schema(roles=tuple(f"r{i}" for i in range(9))), "x", 4, "test").collect()
    assert len(rows) == 4 and {len(json.loads(r.instruction)["schema"]) for r in rows} == {4, 5}
    assert {r.label for r in rows} == {None, '[{"head":"x","relation":"r1","tail":"y","head_type":"P","tail_type":"Q"}]'}
    assert "label" not in C.converted(d.drop("relation"), "RE", C.Schema(roles=("r",)), "x", 4, "test").columns


def test_triples_and_events_and_attributes(spark):
    d = spark.createDataFrame([("t", [("x", "works_at", "y", "P", "Q"), ("x", "works_at", "z", "P", "R")])], RELATIONS)
    s = C.Schema(types=("P_works_at_Q", "P_works_at_R"))
    out = [json.loads(r.output) for r in C.converted(d, "SPO", s, "x", 1).collect()]
    assert sorted(out, key=str) == [{"works_at": [{"subject": "x", "object": "y"}]}, {"works_at": [{"subject": "x", "object": "z"}]}]
    e = spark.createDataFrame([("he won a race", [("won", "win", [("he", "who")])]), ("no", None)], EVENTS)
    s = C.Schema(types=("win", "lose"), type_roles=(("lose", ("who",)), ("win", ("what", "who"))))
    by = {json.loads(r.instruction)["input"]: json.loads(r.output) for r in C.converted(e, "EE", s, "x", -1).collect()}
    assert by["he won a race"] == {"win": [{"trigger": "won", "arguments": {"what": "NAN", "who": "he"}}], "lose": []} and by["no"] == {"win": [], "lose": []}
    own = C.converted(e, "EEA", s, "x", 4, "test").collect()  # the record's own types alone; without any, no rows
    assert [json.loads(r.instruction)["schema"] for r in own] == [[{"event_type": "win", "arguments": ["what", "who"]}]]
    eet = {json.loads(r.instruction)["input"]: json.loads(r.output) for r in C.converted(e, "EET", s, "x", -1).collect()}
    assert eet["he won a race"] == {"win": ["won"], "lose": []}
    k = spark.createDataFrame([("Rome has hills and a river", [("Rome", "has", "hills", None, None), ("Rome", "has", "river", None, None)])], RELATIONS)
    kg = C.converted(k, "KG", C.Schema(type_roles=(("city", ("has", "age")),)), "x", 1).first()
    assert json.loads(kg.output) == {"city": {"Rome": {"has": ["hills", "river"]}}}


def test_half_of_the_negatives(spark):
    d = spark.createDataFrame([(f"t{i}", [("x", "a")]) for i in range(300)], "text string, entity array<struct<entity:string,entity_type:string>>")
    rows = C.converted(d, "NER", C.Schema(tuple("abcdefghij")), "x", -1, rate=0.5).collect()
    sizes = [len(json.loads(r.instruction)["schema"]) for r in rows]
    assert 4.5 < sum(sizes) / len(sizes) < 7 and all(json.loads(r.output)["a"] == ["x"] for r in rows)


def test_split_is_exact(spark):
    d = spark.createDataFrame([(i % 7,) for i in range(1003)], "k int")
    for share in (0, 0.05, 0.5, 1):
        train, test = I.split(d, "k", share)
        assert test.count() == int(1003 * share) and train.count() + test.count() == 1003
        assert sorted(train.unionByName(test).collect()) == sorted(d.collect())
    assert [x.count() for x in I.split(d.limit(0), "k")] == [0, 0]


def test_graph_build_and_store(spark, tmp_path):
    tags = lambda *x: spark.createDataFrame([(t,) for t in x], "tag string")
    objects = spark.createDataFrame([("1", ["a", "b", "a", None]), ("2", []), ("3", None), ("4", ["c", "z"])], "item string, tag_list array<string>")
    nodes, e = build.built({"SCP": objects, "Tag": tags("a", "b", "c", None), "Canon": tags("a"), "Facility": tags("a")})
    assert list(nodes) == ["Tag", "Facility", "Canon", "SCP"]
    want = [("1", "BELONG_T0_CANON", "Canon", "a"), ("1", "HAS_TAG", "Tag", "a"), ("1", "HAS_TAG", "Tag", "b"), ("4", "HAS_TAG", "Tag", "c")]
    assert sorted(map(tuple, e.collect())) == want
    S.write_graph(nodes, e, str(tmp_path / "g"), {"SCP": "item"})
    again, back = S.read_graph(spark, str(tmp_path / "g"), list(nodes))
    assert sorted(map(tuple, back.select("src", "rel", "dst_label", "dst").collect())) == want
    assert {r.label: r.n for r in G.count_nodes(again).collect()} == {"Tag": 4, "Facility": 1, "Canon": 1, "SCP": 4}
    assert sorted(r.tag for r in G.property_values(again["Tag"], "tag").collect()) == ["a", "b", "c"] and G.count_nodes(again, "Tag").count() == 1
    assert [r.item for r in G.indexed(objects, "item").coalesce(1).collect()] == ["1", "2", "3", "4"]
    tails = spark.createDataFrame([("s", ["1", "4", "9"])], "series string, items array<string>")
    assert sorted(r.src for r in G.edges_to(objects, "item", tails, "series", F.col("items"), "IN").collect()) == ["1", "4"]


def test_readers(spark):
    def read(task, *outputs):
        d = spark.createDataFrame([(i, o) for i, o in enumerate(outputs)], "i int, o string")
        return [r.p.asDict(True) for r in d.select("i", M.reader(task)(F.col("o")).alias("p")).orderBy("i").collect()]

    bad = ["no json", "[1]", None]
    r = read("RE", '{"r": [{"head": "a", "tail": "b"}, {"subject": "c"}, 3, {"head": 1, "tail": "x"}], "q": "x"}', *bad)
    assert r[0] == {"ok": True, "items": [{"head": "a", "relation": "r", "tail": "b"}, {"head": "c", "relation": "r", "tail": ""}]} and not any(x["ok"] for x in r[1:])
    e = read("EE", '{"win": [{"trigger": "won", "arguments": {"who": ["he", "NAN"], "what": "NAN", "when": "now"}}, {"trigger": 1}, {"arguments": 2}]}')[0]["items"]
    assert e[0] == {"event_type": "win", "event_trigger": "won", "arguments": [{"argument": "he", "role": "who"}, {"argument": "now", "role": "when"}]}
    assert e[1:] == [{"event_type": "win", "event_trigger": "", "arguments": []}]
    k = read("KG", '{"city": {"Rome": {"has": ["hills", "river"], "age": "old"}, "x": 1}}')[0]["items"]
    assert k == [{"head": "Rome", "relation": r, "tail": t} for r, t in (("has", "hills"), ("has", "river"), ("age", "old"))]
    with pytest.raises(ValueError):
        M.reader("MRC")


def test_event_levels_and_sets(spark):
    one = lambda *e: [(1, [("won", "win", a) for a in e])]
    kind = "id int, event array<struct<event_trigger:string,event_type:string,arguments:array<struct<argument:string,role:string>>>>"
    gold, got = spark.createDataFrame(one([("he", "who")], [("she", "who")]), kind), spark.createDataFrame(one([("he", "who")]), kind)
    level = lambda **kw: {r.level: (r.tp, r.gold, r.pred) for r in M.event_scores(gold, got, ["id"], "event", **kw).collect()}
    assert level() == {"event": (1, 2, 1), "argument": (1, 2, 1)} and level(as_set=True) == {"event": (1, 1, 1), "argument": (1, 2, 1)}
    rows = [("a", 1, "x"), ("a", 2, None), ("b", None, "n")]
    d = spark.createDataFrame(rows, "k string, o int, v string")
    assert sorted(map(tuple, M.last_wins(d, "k", "o").collect())) == [("a", 2, None), ("b", None, "n")]


def test_sources(spark, tmp_path):
    t = lambda name: str(tmp_path / name)
    empty = S.schema_file(spark, t("none.json")).first()
    assert (empty.types, empty.roles, empty.type_roles) == ([], [], {}) and C.Schema.of(empty) == C.Schema()
    (tmp_path / "s.json").write_text('["a", "b"]\n["r"]\n{"a": ["r"]}\n', encoding="utf-8")
    assert C.Schema.of(S.schema_file(spark, t("s.json")).first()) == C.Schema(("a", "b"), ("r",), (("a", ("r",)),))
    d = spark.createDataFrame([(1, "é\"\n"), (2, None)], "id long, v string")
    S.write_json_lines(d, t("lines"))
    assert sorted(map(tuple, S.json_lines(spark, t("lines"), "id long, v string").collect())) == [(1, 'é"\n'), (2, None)]
    S.write_json_array(d, t("array"))
    assert sorted(map(tuple, S.json_array(spark, t("array"), "id long, v string").collect())) == [(1, 'é"\n'), (2, None)]
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "array").glob("part-*"))
    assert json.loads(text) == [{"id": 1, "v": 'é"\n'}, {"id": 2, "v": None}] and json.loads("".join(p.read_text() for p in write_empty(S, d, tmp_path))) == []
    for x in ("a", "b"):
        S.append_text(spark.createDataFrame([(x,)], "t string"), "t", t("dump"))
    assert sorted(r.value for r in spark.read.text(t("dump")).collect()) == ["a", "b"]
    made = []
    build_rows = lambda rows: lambda: made.append(1) or spark.createDataFrame(rows, "x int")
    assert S.cached(spark, t("c"), build_rows([])).count() == 0 and S.cached(spark, t("c"), build_rows([(1,)])).count() == 1 and S.cached(spark, t("c"), build_rows([])).count() == 1 and len(made) == 2
    S.report(d, t("r"))
    assert S.json_lines(spark, t("r"), "id long").count() == 2
    for name in ("scp-1.html", "scp-2/main.html", "scp-2/more/part.html", "scp-2/note.txt"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text("<p>é</p>", encoding="utf-8")
    tree = S.html_tree(spark, t("tree"))
    assert sorted(r.group for r in tree.collect()) == ["scp-1", "scp-2", "scp-2"] and tree.first().html == "<p>é</p>"
    pages = spark.createDataFrame([("g", True, ["a", "b"]), ("g", False, []), ("h", True, ["a"])], "group string, is_main boolean, tag array<string>")
    assert S.groups_with(pages, ["a", "b"]).count() == 2 and S.groups_with(pages, None).count() == 3 and S.groups_with(pages, ["a"], limit=1).count() == 2
    assert sorted(map(tuple, S.vocabulary(spark, {"c": {"k": "d"}}).collect())) == [("c", "k", "d")]


def write_empty(S, d, tmp_path):
    S.write_json_array(d.limit(0), str(tmp_path / "none"))
    return list((tmp_path / "none").glob("part-*"))


def test_quotes_and_chunks(spark):
    assert sentences('他说"好。走。"然后。') == ['他说"好。走。"然后。'] and sentences("{一。}二。") == ["{一。}二。"]
    assert sentences("“（一”。二）。三。") == ["“（一”。二）。", "三。"]
    d = spark.createDataFrame([(1, None, "x")], "k int, a string, b string")
    assert V.record_chunks(d, "k").first().text == '{"k":1,"a":null,"b":"x"}'
    hits = spark.createDataFrame([(1, "s", 0.1), (9, "s", 0.9)], "chunk_id long, source string, score double")
    chunks = spark.createDataFrame([(i, "s", 100) for i in range(12)], "chunk_id long, source string, n_chars int")
    assert V.expanded(hits, chunks).count() == 2 and V.expanded(hits, chunks, most_score=0.5).count() == 1


def test_pages_end_to_end(spark, tmp_path):
    from graphloom.functions import html as H
    from graphloom.operators import pages as P

    page = '<div id="page-content">bare once<p>one</p>twice<p>twice</p><div><a href="x.html">X</a></div></div><div class="page-tags"><span><a>{}</a></span></div>'
    for name, tag in (("a.html", "t1"), ("b/b.html", "t2"), ("b/a.html", "t1"), ("c/z.html", "t1")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(page.format(tag), encoding="utf-8")
    saved = P.saved_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted((r.group, r.path.rsplit("/", 1)[-1], r.is_main) for r in saved.collect()) == [("a", "a.html", True), ("b", "a.html", False), ("b", "b.html", True), ("c", "z.html", True)]
    assert {r.group for r in P.pages_of(spark, str(tmp_path / "out"), "t1").collect()} == {"a", "c"}
    assert P.pages_of(spark, str(tmp_path / "out"), "t2").count() == 2 and P.pages_of(spark, str(tmp_path / "out")).count() == 4
    content = H.parse("once<p>more</p>again<p>again</p>")
    assert [c if isinstance(c, str) else c.tag for c in H.wrapped(content).children] == ["p", "p", "again", "p"]


def test_table_facilities_and_task_forces(spark):
    from graphloom.operators import hubs as E

    rec = spark.createDataFrame(
        [(1, {"编号": "Site-07", "说明x": "d"}, [("scp-1", "a"), ("hub", "b")]), (2, {"编号": "AREA 12"}, None), (3, {"编号": "none"}, [])],
        "pos int, record map<string,string>, links array<struct<href:string,text:string>>",
    )
    got = {r.pos: r for r in E.table_facilities(rec, {"编号": "number", "说明": "description"}, "number", {"site": "站点", "area": "区域"}).collect()}
    assert (got[1].type, got[1].name, got[1].description, got[1].contained, got[1].related) == ("站点", "site-7", "d", ["scp-1"], ["hub"])
    assert (got[2].type, got[2].name, got[2].description, got[2].contained) == ("区域", "area-12", None, []) and (got[3].type, got[3].name) == (None, None)
    rows = spark.createDataFrame([("p", 0, "h1", "MTF“Alias”-Omega"), ("p", 1, "h2", "任务记录"), ("p", 2, "p", "did"), ("q", 0, "p", "x")], "page string, pos int, tag string, text string")
    out = {r.page: r for r in E.task_forces(rows, "page", {"任务": "missions"}).collect()}
    assert out["p"].missions == ["did"] and out["p"].alias == "Omega" and out["q"].name is None and out["q"].missions == []


# Golden rows of the format: (record, schema types by task, chunk size, schemas and outputs of the train rows).
LAY_OFF = (("组织关系-加盟", ("时间", "加盟者", "所加盟组织")), ("组织关系-裁员", ("时间", "裁员方", "裁员人数")))
GOLDEN_EEA = [
    ("不仅仅是中国IT企业在裁员，为何500强的甲骨文也发生了全球裁员", [("裁员", "组织关系-裁员", [("中国IT企业", "裁员方")]), ("裁员", "组织关系-裁员", [("500强的甲骨文", "裁员方")])],
     {"组织关系-裁员": ["裁员", "裁员"]},
     {"组织关系-裁员": [{"trigger": "裁员", "arguments": {"时间": "NAN", "裁员人数": "NAN", "裁员方": "中国IT企业"}}, {"trigger": "裁员", "arguments": {"时间": "NAN", "裁员人数": "NAN", "裁员方": "500强的甲骨文"}}]}),
    ("消息人士透露，猛龙已将前锋萨加巴-科纳特裁掉。此前他与猛龙签下了一份合同。", [("裁掉", "组织关系-裁员", [("猛龙", "裁员方")]), ("签下", "组织关系-加盟", [("前锋萨加巴-科纳特", "加盟者"), ("猛龙", "所加盟组织")]), ("裁掉", "组织关系-裁员", [("猛龙", "裁员方")])],
     {"组织关系-加盟": ["签下"], "组织关系-裁员": ["裁掉", "裁掉"]},
     {"组织关系-加盟": [{"trigger": "签下", "arguments": {"所加盟组织": "猛龙", "时间": "NAN", "加盟者": "前锋萨加巴-科纳特"}}], "组织关系-裁员": [{"trigger": "裁掉", "arguments": {"裁员方": "猛龙", "裁员人数": "NAN", "时间": "NAN"}}] * 2}),
    ("冠军射手被裁掉，欲加入湖人队", [("裁掉", "组织关系-裁员", [])], {"组织关系-裁员": ["裁掉"]}, {"组织关系-裁员": [{"trigger": "裁掉", "arguments": {}}]}),
]
PERSON = ("别名", "出生地点", "出生日期", "死亡地点", "国籍", "职业", "作品", "成就", "籍贯", "职务", "配偶", "父母", "所属组织", "死亡日期", "兄弟姊妹")
GOLDEN_KG = ("嘉永五年11月3日，明治天皇出生，是孝明天皇的第二位皇子。母亲是英照皇太后。真正的生母是权大纳言。万延元年被定为储君，并赐名睦仁。",
             [("明治天皇", "别名", "睦仁"), ("明治天皇", "父母", "孝明天皇"), ("明治天皇", "父母", "英照皇太后"), ("明治天皇", "父母", "权大纳言"), ("孝明天皇", "配偶", "英照皇太后"), ("孝明天皇", "配偶", "权大纳言")],
             {"人物": {"明治天皇": {"别名": "睦仁", "父母": ["孝明天皇", "英照皇太后", "权大纳言"]}, "孝明天皇": {"配偶": ["英照皇太后", "权大纳言"]}}})


def written(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


def read_back(spark, path):
    return [r.asDict() for r in spark.read.json(path).collect()]


def test_golden_event_arguments_from_file_to_file(spark, tmp_path):
    told = [{"text": t, "event": [{"event_trigger": a, "event_type": k, "arguments": [{"argument": x, "role": r} for x, r in args]} for a, k, args in e]} for t, e, *_ in GOLDEN_EEA]
    src = written(tmp_path / "EEA" / "sample.json", [*told, {"text": "none", "event": []}])
    schema = written(tmp_path / "EEA" / "schema.json", [[k for k, _ in LAY_OFF], ["时间"], {k: list(v) for k, v in LAY_OFF}])
    C.convert_file(spark, "EEA", src, str(tmp_path / "train"), schema, 4)
    rows = {json.loads(r["instruction"])["input"]: r for r in read_back(spark, str(tmp_path / "train"))}
    assert set(rows) == {t for t, *_ in GOLDEN_EEA}
    for text, _, triggers, output in GOLDEN_EEA:
        said = json.loads(rows[text]["instruction"])
        assert said["instruction"] == C.INSTRUCTIONS["EEA", "zh"] and rows[text]["task"] == rows[text]["source"] == "EEA"
        assert {s["event_type"]: s["trigger"] for s in said["schema"]} == triggers and all(set(s["arguments"]) == set(dict(LAY_OFF)[s["event_type"]]) for s in said["schema"])
        assert json.loads(rows[text]["output"]) == output
    C.convert_file(spark, "EEA", src, str(tmp_path / "test"), schema, 4, "test")
    rows = {json.loads(r["instruction"])["input"]: r for r in read_back(spark, str(tmp_path / "test"))}
    assert [set(s) for s in json.loads(rows[GOLDEN_EEA[0][0]]["instruction"])["schema"]] == [{"event_type", "arguments"}]
    assert json.loads(rows[GOLDEN_EEA[0][0]]["label"]) == told[0]["event"]


def test_golden_attributes_and_entities(spark, tmp_path):
    text, triples, output = GOLDEN_KG
    src = written(tmp_path / "KG" / "sample.json", [{"id": 1, "text": text, "relation": [dict(zip(("head", "relation", "tail"), x)) for x in triples]}])
    schema = written(tmp_path / "KG" / "schema.json", [["人物_别名_人物"], list(PERSON), {"人物": list(PERSON)}])
    C.convert_file(spark, "KG", src, str(tmp_path / "kg"), schema, 1)
    (row,) = read_back(spark, str(tmp_path / "kg"))
    assert json.loads(row["output"]) == output and list(json.loads(row["output"])["人物"]) == ["明治天皇", "孝明天皇"]
    assert [(s["entity_type"], set(s["attributes"])) for s in json.loads(row["instruction"])["schema"]] == [("人物", set(PERSON))]
    text = "在这里恕弟不恭之罪，敢在尊前一诤：前人论书，每曰“字字有来历，笔笔有出处”，细读公字，何尝跳出前人藩篱，自隶变而后，直至明季，兄有何新出？"
    src = written(tmp_path / "NER" / "sample.json", [{"text": text, "entity": []}])
    schema = written(tmp_path / "NER" / "schema.json", [["人物", "地理位置", "组织机构"], [], {}])
    C.convert_file(spark, "NER", src, str(tmp_path / "ner"), schema, 6)
    C.convert_file(spark, "NER", src, str(tmp_path / "ner_test"), schema, 6, "test")
    (row,) = read_back(spark, str(tmp_path / "ner"))
    assert json.loads(row["output"]) == {"人物": [], "地理位置": [], "组织机构": []} and set(json.loads(row["instruction"])["schema"]) == {"人物", "地理位置", "组织机构"}
    (row,) = read_back(spark, str(tmp_path / "ner_test"))
    assert row["id"].startswith("c74ee8e5")


def test_events_without_trigger_or_arguments(spark):
    d = spark.createDataFrame([("he won", [("", "win", [("", "what"), ("he", "who")]), ("", "win", []), (None, "win", [("x", "other")])])], EVENTS)
    schema = F.array(F.struct(F.lit("win").alias("event_type"), F.array(F.lit("what"), F.lit("who")).alias("arguments")))
    got = d.select(I.event_target(F.col("event"), schema, F.col("text")), I.event_target(F.col("event"), schema, F.col("text"), with_trigger=False)).first()
    assert json.loads(got[0]) == {"win": [{"trigger": "NAN", "arguments": {"what": "NAN", "who": "he"}}, {"trigger": "NAN", "arguments": {}}]}
    assert json.loads(got[1]) == {"win": [{"arguments": {"what": "NAN", "who": "he"}}]}


def test_drawn_triggers_and_roles(spark):
    e = spark.createDataFrame([(f"t{i}", [("a", "T", [("v", "r1")]), ("b", "T", [])]) for i in range(300)], EVENTS)
    s = C.Schema(type_roles=(("T", tuple(f"r{i}" for i in range(10))),))
    items = [json.loads(r.instruction)["schema"][0] for r in C.converted(e, "EEA", s, "x", 4, rate=0.5).collect()]
    assert 4 < sum(len(x["arguments"]) for x in items) / 300 < 6 and 1 < sum(len(x["trigger"]) for x in items) / 300 < 1.5
    assert all(set(x["trigger"]) <= {"a", "b"} and x["arguments"] for x in items)


def test_label_keys(spark):
    d = spark.range(1).select(F.struct(F.lit("p").alias("predicate"), F.lit("a").alias("subject_type"), F.lit("b").alias("object_type")).alias("t"), F.lit("x").alias("n"), F.struct(F.lit("e").alias("event_type")).alias("e"))
    got = d.select(C.label_key("SPO", F.col("t")), C.triple_type(F.col("t")), C.label_key("NER", F.col("n")), C.label_key("EE", F.col("e"))).first()
    assert tuple(got) == ("p", "a_p_b", "x", "e")


def test_split_deals_equal_rows_once(spark):
    d = spark.createDataFrame([(i // 40, "x") for i in range(400)], "k int, v string").repartition(5)
    train, test = I.split(d, "k", 0.33)
    assert test.count() == 132 and train.count() == 268 and train.unionAll(test).groupBy("k").count().where("count <> 40").count() == 0
