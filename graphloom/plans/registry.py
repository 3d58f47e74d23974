"""Every query of the engine by name, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import html as H
from graphloom.functions import text as X
from graphloom.functions.sentences import split_sentences
from graphloom.operators import build as B
from graphloom.operators import conversion as C
from graphloom.operators import evaluation as M
from graphloom.operators import graph as G
from graphloom.operators import hubs as E
from graphloom.operators import instructions as I
from graphloom.operators import knn as K
from graphloom.operators import legacy as L
from graphloom.operators import mining as N
from graphloom.operators import vectors as V
from graphloom.plans import hub_queries, text_queries  # noqa: F401
from graphloom.plans.base import ORACLES, QUERIES, query  # noqa: F401

def c(name):
    return F.col(name)


def n_rows():
    return F.count(F.lit(1))


def supplied(t):
    return t("lineitem").select(c("l_partkey").alias("src"), F.lit("SUPPLIED_BY").alias("rel"), c("l_suppkey").alias("dst"))


@query("SELECT count(*) AS paths FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 2))")
def graph_path_count_or(t):
    of = t("supplier").select(c("s_suppkey").alias("src"), F.lit("IN").alias("rel"), c("s_nationkey").alias("dst"))
    p = G.Pattern(t("part"), "part").out(supplied(t), "p_partkey", t("supplier"), "supplier", "s_suppkey")
    p = p.out(of, "s_suppkey", t("nation"), "nation", "n_nationkey", c("n_nationkey").isin(1, 2))
    return p.rows.agg(n_rows().alias("paths"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def graph_tag_objects(t):
    p = t("part")
    tag = p.agg(F.min("p_brand").alias("tag"))
    return G.key_edges(p, "p_partkey", "p_brand", tag, "tag", "tag", "HAS_TAG").join(p, c("src") == c("p_partkey")).select("p_partkey", "p_name")


@query("""
SELECT n_name, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def graph_two_hop_collect(t):
    e1 = t("orders").select(c("o_orderkey").alias("src"), c("o_custkey").alias("dst"))
    e2 = t("customer").select(c("c_custkey").alias("src"), c("c_nationkey").alias("dst"))
    p = G.Pattern(t("orders"), "o").out(e1, "o_orderkey", t("customer"), "cu", "c_custkey").out(e2, "c_custkey", t("nation"), "na", "n_nationkey")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o.o_orderkey")), lambda x: x.cast("string")), ",")
    return p.rows.groupBy(c("na.n_name").alias("n_name")).agg(ids.alias("ids"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part WHERE contains(p_name, 'a')) GROUP BY word")
def graph_contains_unwind_count(t):
    return t("part").where(F.contains("p_name", F.lit("a"))).select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(n_rows().alias("n"))


@query("SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def graph_point_lookup(t):
    return G.find(t("customer"), "c_custkey", 42).select("c_name", "c_acctbal")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def graph_two_predicates(t):
    o = t("orders")
    return o.join(F.broadcast(o.agg(F.min("o_orderpriority").alias("p"))), (c("o_orderpriority") == c("p")) & (c("o_orderstatus") != "F")).agg(n_rows().alias("n"))


@query("SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3")
def graph_having_distinct(t):
    return supplied(t).groupBy(c("src").alias("part")).agg(F.count_distinct("dst").alias("suppliers")).where("suppliers >= 3")


@query("SELECT l_suppkey AS supplier, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def graph_top1(t):
    return supplied(t).groupBy(c("dst").alias("supplier")).agg(n_rows().alias("n")).orderBy(F.desc("n"), "supplier").limit(1)


@query("SELECT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def graph_edge_intersection(t):
    l = t("lineitem").select(c("l_partkey").alias("part"), c("l_suppkey").alias("supplier"), "l_returnflag")
    return l.where("l_returnflag = 'R'").drop("l_returnflag").intersect(l.where("l_returnflag = 'A'").drop("l_returnflag"))


@query("SELECT l_partkey AS part, min(l_suppkey) AS supplier FROM lineitem GROUP BY 1")
def containment_first_wins(t):
    return G.first_wins(supplied(t).select(c("src").alias("part"), c("dst").alias("supplier")), "part", "supplier")


@query("SELECT DISTINCT c_name AS tag FROM customer EXCEPT SELECT c_name FROM customer WHERE c_acctbal < 0")
def tag_nodes_missing(t):
    cu = t("customer")
    return G.missing(cu, "c_name", cu.where("c_acctbal < 0").select(c("c_name").alias("tag")), "tag")


@query("SELECT 'SUPPLIED_BY' AS rel, count(*) AS n FROM lineitem UNION ALL SELECT 'IN', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def edge_counts_by_relation(t):
    return G.count_edges(supplied(t).unionByName(G.key_edges(t("supplier"), "s_suppkey", "s_nationkey", t("nation"), "n_nationkey", "n_nationkey", "IN")))


@query("SELECT p_brand AS src, count(*) * count(*) AS n FROM part GROUP BY 1")
def node_as_tail_bag(t):
    p = t("part")
    return G.as_tail(p, "p_partkey", "p_brand", p.select("p_brand").distinct(), "p_brand", "IS_TAG_OF", bag=True).groupBy("src").agg(F.sum("n").alias("n"))


@query("SELECT p_brand AS src, count(*) AS n FROM part GROUP BY 1")
def node_as_tail_distinct(t):
    p = t("part")
    return G.as_tail(p, "p_partkey", "p_brand", p.select("p_brand").distinct(), "p_brand", "IS_TAG_OF").groupBy("src").agg(n_rows().alias("n"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def from_tag_anti_join(t):
    return t("nation").join(t("supplier").where("s_acctbal < 0"), c("n_nationkey") == c("s_nationkey"), "left_anti").select("n_nationkey", "n_name")


@query("SELECT count(*) AS n, count(*) FILTER (length(text) > 100) AS with_text, count(*) FILTER (length(source) > 100) AS with_source FROM documents")
def completeness_report(t):
    return E.completeness(t("documents"), ["text", "source"], 100)


@query(r"SELECT page_id, regexp_replace(lower(url), '\.html.*$', '') AS address FROM pages")
def strip_address(t):
    return t("pages").select("page_id", X.strip_address(F.lower("url")).alias("address"))


@query(r"SELECT s_suppkey, CASE WHEN regexp_matches(lower(replace(s_name, '#', '-')), '^.*-0+[1-9](-[0-9]*)?$') THEN regexp_replace(lower(replace(s_name, '#', '-')), '0+([1-9])', '\1', 'g') ELSE lower(replace(s_name, '#', '-')) END AS name FROM supplier")
def unify_name(t):
    return t("supplier").select("s_suppkey", X.unify_name(F.replace(c("s_name"), F.lit("#"), F.lit("-"))).alias("name"))


@query("SELECT doc_id, sha256(text) AS id FROM documents")
def stable_id(t):
    return t("documents").select("doc_id", X.stable_id(c("text")).alias("id"))


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\x20-\x7E\t\n\r\x0B\x0C]+'), lambda x: regexp_matches(x, '[\x21-\x7E]'))) AS runs FROM documents")
def printable_runs(t):
    return t("documents").select("doc_id", F.size(X.printable_runs(c("text"))).cast("long").alias("runs"))


@query(r"SELECT e AS entity, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS e FROM documents) GROUP BY 1")
def entity_frequency(t):
    e = F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{6,}"), F.lit(0))
    return t("documents").select(F.explode(e).alias("entity")).groupBy("entity").agg(n_rows().alias("n"))


@query()
def sentence_split(t):
    return t("documents").select("doc_id", F.posexplode(split_sentences(c("text"), ".!?")).alias("pos", "sentence"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]+)\"')) AS links FROM pages")
def page_link_counts(t):
    return t("pages").select("page_id", F.size(H.linked(c("html"), suffix="")).cast("long").alias("links"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS link FROM pages")
def page_links(t):
    return t("pages").select("page_id", F.explode(H.linked(c("html"), suffix="")).alias("l")).select("page_id", c("l.link").alias("link"))


@query("""
WITH s AS (SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS s FROM customer GROUP BY 1),
f AS (SELECT c_nationkey, s, greatest(len(s) // 4, 1) AS full_, greatest(len(s) - 4 * greatest(len(s) // 4, 1), 0) AS rest FROM s),
k AS (SELECT *, unnest(range(full_ + CASE WHEN rest >= 2 THEN 1 ELSE 0 END)) AS chunk FROM f)
SELECT c_nationkey, CAST(chunk AS BIGINT) AS chunk, CASE WHEN rest < 2 AND chunk = full_ - 1 THEN s[chunk * 4 + 1:] ELSE s[chunk * 4 + 1:chunk * 4 + 4] END AS keys FROM k
""")
def schema_chunks(t):
    """The customers of a nation in chunks of four; a rest of one joins the last chunk."""
    s = t("customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("s"))
    return s.select("c_nationkey", F.posexplode(I.chunks(c("s"), 4)).alias("chunk", "keys")).select("c_nationkey", c("chunk").cast("long").alias("chunk"), "keys")


@query("SELECT p_partkey, CAST(len(list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_name, ' '))) AS BIGINT) AS labels FROM part")
def label_dedupe(t):
    words = t("part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ").alias("w"))
    return words.select("p_partkey", F.size(I.first_of_each(c("w"), lambda x: x)).cast("long").alias("labels"))


@query("SELECT event_type, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS ks FROM (SELECT DISTINCT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def label_group_json(t):
    e = t("events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).distinct()
    return e.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string")), ",").alias("ks"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT c_custkey, s AS negative FROM customer, (SELECT DISTINCT c_mktsegment AS s FROM customer) WHERE s <> c_mktsegment")
def negative_set(t):
    cu = t("customer")
    every = F.broadcast(cu.agg(F.array_sort(F.collect_set("c_mktsegment")).alias("every")))
    return cu.join(every, F.lit(True)).select("c_custkey", F.explode(I.negatives(c("every"), F.array("c_mktsegment"), 1, c("c_custkey"))).alias("negative"))


@query("""
WITH g AS (SELECT source, quality AS item, count(*) AS g FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
p AS (SELECT source, CAST(n_chars > 1500 AS INTEGER) AS item, count(*) AS p FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
j AS (SELECT source, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p USING (source, item)),
t AS (SELECT source, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(p) AS BIGINT) AS pred FROM j GROUP BY ROLLUP (source)),
r AS (
  SELECT *, CASE WHEN pred = 0 THEN 0.0::DOUBLE ELSE round(tp::DOUBLE / pred * 100, 2) END AS "precision",
    CASE WHEN gold = 0 THEN 0.0::DOUBLE ELSE round(tp::DOUBLE / gold * 100, 2) END AS recall FROM t
)
SELECT *, CASE WHEN "precision" + recall = 0 THEN 0.0::DOUBLE ELSE round(2 * "precision" * recall / ("precision" + recall), 2) END AS f1 FROM r
""")
def f1_by_source(t):
    d = t("labels").join(t("documents"), "doc_id")
    k = M.counts(d.select("source", c("quality").alias("item")), d.select("source", (c("n_chars") > 1500).cast("int").alias("item")), ["source"], "item")
    return M.totals(k, ["source"])


@query("SELECT text, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1")
def gold_pred_join_last_wins(t):
    return M.last_wins(t("documents").select("text", "doc_id"), "text", "doc_id")


@query("SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 4) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 3")
def vector_topk(t):
    e = t("embeddings")
    q = e.where("vec_id = 7").select("embedding").first()[0]
    return V.top_k(e, q).select("vec_id", F.round("distance", 4).alias("distance"))


@query("""
WITH d AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0
)
SELECT query_id, vec_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank FROM d) WHERE rank <= 3
""")
def vector_topk_batch(t):
    e = t("embeddings")
    return V.top_k_batch(e, e.where("vec_id % 100 = 0")).select("query_id", "vec_id", "rank")


@query("""
WITH d AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0
), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, vec_id, rank, round(d, 6) AS distance FROM k WHERE rank <= 10
""")
def vector_knn_join(t):
    """The ten nearest rows of every hundredth one, by pivots."""
    e = t("embeddings")
    return K.knn_join(e, e.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query("WITH o AS (SELECT o_orderkey AS k, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS r FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'F')) SELECT min(k) AS run_start, max(k) AS run_end, count(*) AS n FROM o GROUP BY r")
def consecutive_runs(t):
    o = t("orders").where("o_orderstatus <> 'F'").select(F.lit(1).alias("one"), "o_orderkey")
    return G.runs(o, ["one"], "o_orderkey").drop("one")


@query("SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '</s>' || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10) AS prompt FROM conversations GROUP BY 1")
def chat_prompt(t):
    s = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.transform(s, lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("</s>\n")))
    return t("conversations").groupBy("conv_id").agg(F.concat(F.array_join(lines, ""), F.lit("<|assistant|>\n")).alias("prompt"))


@query("SELECT n_nationkey, coalesce(s, 0) AS suppliers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey")
def object_lookup(t):
    s = t("supplier").groupBy("s_nationkey").agg(n_rows().alias("s"))
    return t("nation").join(s, c("n_nationkey") == c("s_nationkey"), "left").select("n_nationkey", F.coalesce("s", F.lit(0)).alias("suppliers"))


@query()
def train_test_split(t):
    _, test = I.split(t("documents").select("doc_id"), "doc_id")
    return test


@query()
def page_text_blocks(t):
    p = t("pages").select("page_id", H.parsed(c("html")).alias("p"))
    return p.select("page_id", F.posexplode("p.blocks").alias("pos", "block"))


@query(r"SELECT text, list_sort(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS entities FROM (SELECT DISTINCT text FROM documents) WHERE regexp_matches(text, '[A-Z][a-z]{6,}')")
def regex_entities(t):
    s = N.matches(t("documents"), "text", r"[A-Z][a-z]{6,}", "word")
    return s.select("text", F.array_sort("entity.entity").alias("entities"))


@query(r"WITH s AS (SELECT text, 0 AS k, regexp_extract_all(text, '[A-Z][a-z]{6,}') AS e FROM (SELECT DISTINCT text FROM documents) UNION ALL SELECT text, 1, regexp_extract_all(text, '[A-Z][a-z]{2,3}') FROM (SELECT DISTINCT text FROM documents)), x AS (SELECT text, k, unnest(e) AS e FROM s WHERE len(e) > 0), o AS (SELECT e, count(*) AS often FROM x GROUP BY e) SELECT text, count(DISTINCT k) AS kinds, max(often) AS frequency, count(*) AS entities FROM x JOIN o USING (e) GROUP BY text ORDER BY kinds DESC, frequency, entities DESC, min(k), max(length(e)), text LIMIT 50")
def rank_samples(t):
    return N.ranked_matches(t("documents"), "text", {"long": r"[A-Z][a-z]{6,}", "short": r"[A-Z][a-z]{2,3}"}, 50).select("text", c("entity_type_count").alias("kinds"), "frequency", "entities")


@query("WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_name || 's', ' ') AS w FROM part) SELECT p_partkey, array_to_string(list_filter(w, lambda m: len(list_filter(w, lambda y: y <> m AND contains(y, m))) = 0), ' ') AS kept FROM w")
def substring_elimination(t):
    w = F.split(F.concat("p_name", F.lit(" "), "p_name", F.lit("s")), " ")
    return t("part").select("p_partkey", F.array_join(X.substring_eliminated(w), " ").alias("kept"))


@query("SELECT DISTINCT event_type AS type, string_agg(DISTINCT props, '|' ORDER BY props) AS roles FROM events GROUP BY 1")
def roles_by_event_type(t):
    arguments = F.array(F.struct(c("props").alias("role")))
    e = t("events").select(F.array(F.struct("event_type", arguments.alias("arguments"))).alias("event"))
    return L.roles_by_type(e, "event", "event_type", "arguments", "role").select("type", F.array_join("roles", "|").alias("roles"))


@query("SELECT c_custkey, '(' || c_name || ',' || c_mktsegment || ')' AS output FROM customer")
def tuple_format(t):
    return t("customer").select("c_custkey", L.tuples(F.array(F.struct("c_name", "c_mktsegment")), "c_name", "c_mktsegment").alias("output"))


@query("WITH g AS (SELECT doc_id, quality AS item FROM labels), p AS (SELECT doc_id, CAST(n_chars > 1500 AS INTEGER) AS item FROM documents SEMI JOIN labels USING (doc_id)) SELECT CAST(count(*) FILTER (g.item = p.item) AS BIGINT) AS tp, count(g.item) AS gold, count(p.item) AS pred FROM g FULL JOIN p USING (doc_id)")
def multiset_f1(t):
    g = t("labels").select("doc_id", c("quality").alias("item"))
    p = t("documents").join(t("labels"), "doc_id", "left_semi").select("doc_id", (c("n_chars") > 1500).cast("int").alias("item"))
    return M.counts(g, p, ["doc_id"], "item").agg(*[F.sum(x).alias(x) for x in ("tp", "gold", "pred")])


FAN_OUT_SQL = " UNION ALL ".join(
    f"SELECT src, '{rel}' AS rel, '{label}' AS dst_label, dst FROM e WHERE {where}"
    for label, rel, where in (
        ("Tag", "HAS_TAG", "dst IN (SELECT w FROM words)"),
        ("Attribute", "HAS_ATTRIBUTE", "dst IN (SELECT w FROM words WHERE length(w) <= 5)"),
        ("Character", "RELATE_TO_CHARACTER", "dst IN (SELECT p_brand FROM part)"),
        ("GroupOfInterest", "RELATE_TO_GROUP", "dst IN (SELECT p_type FROM part)"),
        ("Series", "BELONG_T0_SERIES", "dst IN (SELECT p_type FROM part WHERE p_size < 5)"),
        ("Canon", "BELONG_T0_CANON", "dst IN (SELECT min(p_brand) FROM part)"),
    )
)


@query(f"""
WITH words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
e AS (SELECT DISTINCT p_partkey AS src, unnest(list_concat(string_split(p_name, ' '), [p_brand, p_type, p_type])) AS dst FROM part)
{FAN_OUT_SQL}
""")
def graph_build(t):
    """Six labels of tags, and the edges of all objects to them."""
    p = t("part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("tag")).distinct()
    of = lambda rows, name: rows.select(c(name).alias("tag")).distinct()
    sources = {
        "Tag": words, "Attribute": words.where("length(tag) <= 5"), "Character": of(p, "p_brand"), "GroupOfInterest": of(p, "p_type"),
        "Series": of(p.where("p_size < 5"), "p_type"), "Canon": p.agg(F.min("p_brand").alias("tag")),
        "SCP": p.select(c("p_partkey").alias("item"), F.concat(F.split("p_name", " "), F.array("p_brand", "p_type", "p_type")).alias("tag_list")),
    }
    return B.built(sources)[1]


PARTS_SQL = """
words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
brands AS (SELECT p_brand AS name, CASE WHEN p_brand < 'Brand#2' THEN 'b1' ELSE p_brand END AS tag FROM (SELECT DISTINCT p_brand FROM part)),
own AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS src, unnest(list_concat(string_split(p_name, ' '), [p_type, CASE WHEN p_brand < 'Brand#2' THEN 'b1' ELSE p_brand END])) AS t FROM part),
held AS (SELECT l_partkey, l_suppkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
"""


@query(f"""
WITH {PARTS_SQL}, e AS (
  SELECT 'Tag' AS src_label, tag AS src, 'IS_TAG_OF' AS rel, 'GroupOfInterest' AS dst_label, name AS dst, count(*) OVER (PARTITION BY tag) AS n FROM brands
  UNION ALL SELECT 'Tag', p_type, 'IS_TAG_OF', 'Series', p_type, 1 FROM (SELECT DISTINCT p_type FROM part)
  UNION ALL SELECT 'SCP', CAST(l_partkey AS VARCHAR), 'IS_CONTAINED_IN_FACILITY', 'Facility', CAST(min(s_nationkey) AS VARCHAR), 1 FROM held GROUP BY l_partkey
  UNION ALL SELECT DISTINCT 'SCP', CAST(l_partkey AS VARCHAR), 'IS_CONTAINED_BY_TASKFORCE', 'TaskForce', CAST(l_suppkey AS VARCHAR), 1 FROM held
  UNION ALL SELECT 'SCP', src, 'HAS_TAG', 'Tag', t, 1 FROM own
  UNION ALL SELECT 'SCP', src, 'RELATE_TO_GROUP', 'GroupOfInterest', name, 1 FROM own JOIN brands ON t = tag
  UNION ALL SELECT 'SCP', src, 'BELONG_T0_SERIES', 'Series', t, 1 FROM own WHERE t IN (SELECT p_type FROM part)
) SELECT src_label, rel, dst_label, count(*) AS edges, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT src) AS heads, count(DISTINCT dst) AS tails, min(src || '>' || dst) AS least, max(src || '>' || dst) AS most FROM e GROUP BY ALL
""")
def graph_whole_build(t):
    """Parts as objects: their words, brands and types as tags, nations as facilities and suppliers as forces; all nodes, missing tags and edges are built, then told by relation."""
    e = parts_graph(t)[1]
    pair = F.concat_ws(">", "src", "dst")
    told = [n_rows().alias("edges"), F.sum("n").alias("n"), F.count_distinct("src").alias("heads"), F.count_distinct("dst").alias("tails"), F.min(pair).alias("least"), F.max(pair).alias("most")]
    return e.groupBy("src_label", "rel", "dst_label").agg(*told)


def parts_graph(t):
    p = t("part")
    brand = F.when(c("p_brand") < "Brand#2", "b1").otherwise(c("p_brand"))
    held = t("lineitem").join(t("supplier"), c("l_suppkey") == c("s_suppkey"))
    pairs = lambda key: held.select(key, c("l_partkey").alias("objects")).distinct()
    sources = {
        "Tag": p.select(F.explode(F.split("p_name", " ")).alias("tag")).distinct(),
        "GroupOfInterest": p.select(c("p_brand").alias("name"), brand.alias("tag")).distinct(),
        "Series": p.select(c("p_type").alias("name"), c("p_type").alias("tag")).distinct(),
        "SCP": p.select(c("p_partkey").alias("item"), F.concat(F.split("p_name", " "), F.array(c("p_type"), brand)).alias("tag_list")),
        "Facility": t("nation"), "TaskForce": t("supplier"),
    }
    keys = {"GroupOfInterest": "name", "Series": "name", "SCP": "item", "Facility": "n_nationkey", "TaskForce": "s_suppkey"}
    return B.built_graph(sources, keys, facilities=B.Holders(pairs("s_nationkey"), "s_nationkey", "objects"), forces=B.Holders(pairs("l_suppkey"), "l_suppkey", "objects"))


STAR_EDGES_SQL = """
e AS (
  SELECT 'Nation:' || n_nationkey AS a, 'Region:' || n_regionkey AS b FROM nation UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey FROM customer UNION ALL SELECT 'Order:' || o_orderkey, 'Customer:' || o_custkey FROM orders
), d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)
"""


@query(f"""
WITH RECURSIVE {STAR_EDGES_SQL}, r AS (SELECT 'Nation:' || min(n_nationkey) AS id, 0 AS hops FROM nation UNION SELECT b, hops + 1 FROM r JOIN d ON id = a WHERE hops < 3),
f AS (SELECT id, min(hops) AS hops FROM r GROUP BY id)
SELECT string_split(id, ':')[1] AS label, string_split(id, ':')[2] AS key, CAST(hops AS INTEGER) AS hops, coalesce(n_name, r_name, s_name, c_name, o_orderpriority) AS name
FROM f LEFT JOIN nation ON id = 'Nation:' || n_nationkey LEFT JOIN region ON id = 'Region:' || r_regionkey LEFT JOIN supplier ON id = 'Supplier:' || s_suppkey
LEFT JOIN customer ON id = 'Customer:' || c_custkey LEFT JOIN orders ON id = 'Order:' || o_orderkey
""")
def graph_all_related(t):
    """All nodes within three edges of a nation, whatever their labels and relations, each as a whole."""
    of = lambda table, label, key, far, rel, to: t(table).select(F.lit(label).alias("src_label"), c(key).cast("string").alias("src"), F.lit(rel).alias("rel"), F.lit(to).alias("dst_label"), c(far).cast("string").alias("dst"))
    e = of("nation", "Nation", "n_nationkey", "n_regionkey", "IN", "Region").unionByName(of("supplier", "Supplier", "s_suppkey", "s_nationkey", "IN", "Nation"))
    e = e.unionByName(of("customer", "Customer", "c_custkey", "c_nationkey", "IN", "Nation")).unionByName(of("orders", "Order", "o_orderkey", "o_custkey", "BY", "Customer"))
    start = t("nation").agg(F.min("n_nationkey").cast("string").alias("key")).select(F.lit("Nation").alias("label"), "key")
    nodes = {"Nation": t("nation"), "Region": t("region"), "Supplier": t("supplier"), "Customer": t("customer"), "Order": t("orders")}
    keys = {"Nation": "n_nationkey", "Region": "r_regionkey", "Supplier": "s_suppkey", "Customer": "c_custkey", "Order": "o_orderkey"}
    found = G.whole_nodes(G.related(e, start, 3), nodes, keys)
    return found.select("label", "key", "hops", F.coalesce(*[c("node")[x] for x in ("n_name", "r_name", "s_name", "c_name", "o_orderpriority")]).alias("name"))


@query("SELECT 'nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def node_counts(t):
    return G.count_nodes({l: t(l) for l in ("nation", "customer", "part")})


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def property_collect(t):
    return G.property_values(t("part"), "p_brand").groupBy(c("p_brand").alias("value")).agg(n_rows().alias("n"))


@query("SELECT DISTINCT l_partkey AS src, 'IN' AS rel, l_suppkey AS dst FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'")
def edges_of_many_heads(t):
    """Many heads to a tail: each supplier lists the parts that came back, which are its heads."""
    lists = t("lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("heads"))
    s = t("supplier").join(lists, c("s_suppkey") == c("l_suppkey"))
    return G.edges_to(t("part"), "p_partkey", s, "s_suppkey", c("heads"), "IN")


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS text FROM events")
def record_chunks(t):
    return V.record_chunks(t("events").select("event_id", "event_type"), "event_id")


SEGMENTS_SQL = "(SELECT list_sort(list(DISTINCT c_mktsegment)) FROM customer)"
SENTENCE = C.INSTRUCTIONS["NER", "en"].replace("'", "''")


def segment_records(t):
    cu = t("customer")
    types = tuple(r[0] for r in cu.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect())  # the schema: a few types
    entity = F.array(F.struct(c("c_name").alias("entity"), c("c_mktsegment").alias("entity_type")))
    return cu.select(c("c_name").alias("text"), entity.alias("entity")), C.Schema(types)


def chunk_sql(every: str) -> str:
    """Chunks of three of a list of five types: three and two."""
    return f"SELECT c_name, c_mktsegment, {every}[1:3] AS s FROM customer UNION ALL SELECT c_name, c_mktsegment, {every}[4:5] FROM customer"


def instruction_sql() -> str:
    return f"""'{{"instruction":"{SENTENCE}","schema":["' || array_to_string(s, '","') || '"],"input":"' || c_name || '"}}'"""


@query(f"""
WITH k AS ({chunk_sql(f"list_concat([c_mktsegment], list_filter({SEGMENTS_SQL}, lambda x: x <> c_mktsegment))")})
SELECT 'NER' AS task, 'segments' AS source, {instruction_sql()} AS instruction,
  '{{' || array_to_string(list_transform(s, lambda x: '"' || x || '":' || CASE WHEN x = c_mktsegment THEN '["' || c_name || '"]' ELSE '[]' END), ',') || '}}' AS output FROM k
""")
def convert_train(t):
    records, schema = segment_records(t)
    return C.converted(records, "NER", schema, C.source_of("/data/segments/train.json"), 3, "train", language="en", shuffled=False)


@query(f"""
WITH k AS ({chunk_sql(SEGMENTS_SQL)})
SELECT sha256(c_name) AS id, 'NER' AS task, 'segments' AS source, {instruction_sql()} AS instruction,
  '[{{"entity":"' || c_name || '","entity_type":"' || c_mktsegment || '"}}]' AS label FROM k
""")
def convert_test(t):
    records, schema = segment_records(t)
    return C.converted(records, "NER", schema, C.source_of("/data/segments/test.json"), 3, "test", language="en")


@query("""
WITH e AS (
  SELECT user_id, event_type AS type, CAST(json_extract(props, '$.k') AS VARCHAR) AS trigger, event_type AS role, value > 40 AS g, value < 90 AS p FROM events
), i AS (
  SELECT user_id, 'event' AS level, type || '|' || trigger AS item, g, p FROM e
  UNION ALL SELECT user_id, 'argument', type || '|' || trigger || '|' || role, g, p FROM e
), k AS (SELECT user_id, level, item, count(*) FILTER (g) AS g, count(*) FILTER (p) AS p FROM i GROUP BY ALL)
SELECT level, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(p) AS BIGINT) AS pred FROM k GROUP BY 1
""")
def event_scores(t):
    k = F.get_json_object("props", "$.k")
    one = F.array(F.struct("event_type", k.alias("event_trigger"), F.array(F.struct(k.alias("argument"), c("event_type").alias("role"))).alias("arguments")))
    e = t("events").select("user_id", "value", one.alias("event"))
    s = M.event_scores(e.where("value > 40"), e.where("value < 90"), ["user_id"], "event")
    return s.groupBy("level").agg(*[F.sum(x).alias(x) for x in ("tp", "gold", "pred")])


@query("""
WITH g AS (SELECT DISTINCT source, quality AS item, 1 AS g FROM labels JOIN documents USING (doc_id)),
p AS (SELECT DISTINCT source, CAST(n_chars > 1500 AS INTEGER) AS item, 1 AS p FROM labels JOIN documents USING (doc_id))
SELECT source, CAST(sum(coalesce(g, 0) * coalesce(p, 0)) AS BIGINT) AS tp, CAST(sum(coalesce(g, 0)) AS BIGINT) AS gold, CAST(sum(coalesce(p, 0)) AS BIGINT) AS pred
FROM g FULL JOIN p USING (source, item) GROUP BY 1
""")
def set_mode_counts(t):
    d = t("labels").join(t("documents"), "doc_id")
    return M.counts(d.select("source", c("quality").alias("item")), d.select("source", (c("n_chars") > 1500).cast("int").alias("item")), ["source"], "item", as_set=True)
