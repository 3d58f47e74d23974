"""A Merkle manifest of a dataset: a tree of digests for each source, one tree over all sources, and a proof for each row.

A row's leaf is the digest of its fields, in a source leaves ascend by doc_id, and every 16 consecutive nodes become one.

1. Ranks. An order-preserving hexadecimal key of the doc_id (then of the leaf, where ids tie) is cut into digits of base 256.
   Rows are counted by each prefix of the key, level by level; a prefix's first rank is the sum of its smaller siblings on each
   level above it, and within the last prefix of at most 256 ids rows are put in order. No source is sorted as a whole.
2. Trie. The digits of a rank in base 16 name its place in a trie: nodes that share all but the last digit
   become one, the longest prefixes first, until a source has one node, its subroot.
3. The subroots are ranked by source (range partitions and their counts) and climb a second trie to the root.
4. Proofs come down: a node hands its children and its own path on to the nodes below, so that leaves, which lie in the lowest
   nodes, meet no table again.

Every group holds 16 nodes or 256 ids; levels are written tables, each a sixteenth of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import saved, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a prefix that are put in order at once, unless they tie by doc_id: then digits of the leaf split them further.
TIES = 1 << 12
#: Sources that are put in order at once, about.
SOURCES = 1 << 12
#: Characters of the key that hold the doc_id: a mark for nulls, which come first, and 16 digits.
ID_CHARS = 17


def digest(*fields: Column) -> Column:
    """H of the fields: each ``-`` if null, else its number of UTF-8 bytes, a colon and itself."""
    told = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*told), 256)


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row, or of the row with another ``text``."""
    return digest(*[text if text is not None and c == "text" else F.col(f"`{c}`").cast("string") for c in FIELDS])


def joined(kids: Column) -> Column:
    return F.sha2(F.array_join(kids, ""), 256)


def common_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, doc_id, leaf, data, times), distinct by the first three: a row for each of the ``times`` copies, with its ``rank`` in the tree and ``n``, the tree's leaves."""
    flip = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), ID_CHARS - 1, "0")
    key = F.coalesce(F.concat(F.lit("1"), flip), F.lit("0" * ID_CHARS))
    rows = saved(rows.withColumn("key", F.concat(key, "leaf")), "merkle_leaves")
    ends = rows.agg(F.min(F.substring("key", 1, ID_CHARS)).alias("a"), F.max(F.substring("key", 1, ID_CHARS)).alias("b")).first()
    same = common_prefix(ends["a"], ends["b"]) if ends["a"] is not None else 0
    cuts = [c for c in range(3, ID_CHARS - 1, 2) if c > same] or [ID_CHARS - 2]
    prefix = lambda name, c: F.substring(name, 1, c)
    counts = lambda c: saved(rows.groupBy("tree", prefix("key", c).alias("p")).agg(F.sum("times").alias("c"), F.count(F.lit(1)).alias("own")), "merkle_counts")
    finest = counts(cuts[-1])
    most = finest.agg(F.max("own")).first()[0] or 0
    if most > TIES:  # more rows than ids: digits of the leaf tell those of one doc_id apart
        cuts.append(ID_CHARS)
        while most > TIES:
            cuts.append(cuts[-1] + 2)
            most /= 256
        finest = counts(cuts[-1])
    levels = [finest.select("tree", "p", "c")]
    for c in reversed(cuts[:-1]):
        levels.insert(0, levels[0].groupBy("tree", prefix("p", c).alias("p")).agg(F.sum("c").alias("c")))
    before = lambda what, *by: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = levels[0].select("tree", "p", before("c", "tree").alias("base"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    for c, level in zip(cuts, levels[1:]):
        here = level.withColumn("up", prefix("p", c)).select("tree", "p", "up", before("c", "tree", "up").alias("own"))
        base = here.join(base.withColumnRenamed("p", "up"), ["tree", "up"]).select("tree", "p", (F.col("base") + F.col("own")).alias("base"), "n")
    inner = Window.partitionBy("tree", "p").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("p", prefix("key", cuts[-1])).withColumn("own", F.coalesce(F.sum("times").over(inner), F.lit(0)))
    placed = placed.join(base, ["tree", "p"]).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return placed.select("tree", (F.col("base") + F.col("own") + F.col("i")).alias("rank"), "n", F.col("leaf").alias("h"), "data")


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the tries over ``nodes`` (tree, rank, n, h, data), lowest first, and (tree, h) of their tops.

    A level has (tree, p, n, kids, h): ``p`` is the rank without as many last digits, ``kids`` are the digests below, on the
    lowest level with their data. A lone node is its tree's top itself.
    """
    kid = F.struct("rank", "h", "data")
    low = nodes.groupBy("tree", F.shiftright("rank", 4).alias("p")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(kid)).alias("kids"))
    level = saved(low.withColumn("h", F.when(F.col("n") == 1, F.col("kids")[0]["h"]).otherwise(joined(F.col("kids.h")))), "merkle_level")
    levels, tops = [level], []
    most = level.agg(F.max("n")).first()[0] or 0
    while True:
        more = F.shiftright(F.col("n") - 1, 4 * len(levels)) > 0
        tops.append(level.where(~more).select("tree", "h"))
        if (most - 1) >> 4 * len(levels) <= 0:
            break
        up = level.where(more).groupBy("tree", F.shiftright("p", 4).alias("up")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("p", "h"))).alias("k"))
        level = saved(up.select("tree", F.col("up").alias("p"), "n", F.col("k.h").alias("kids"), joined(F.col("k.h")).alias("h")), "merkle_level")
        levels.append(level)
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return levels, out


def entry(at: Column, kids: Column) -> Column:
    return F.array(F.struct(at.cast("int").alias("at"), kids.alias("kids")))


def proved(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, h, data, top, path) of each leaf of the tries, by ``tops`` (tree, top, path): the path of a leaf holds, from below, its place among its run and the run's digests, then what its top has."""
    found = None
    for k in reversed(range(len(levels))):
        level, depth = levels[k], 4 * (k + 1)
        is_top = F.shiftright(F.col("n") - 1, depth) == 0
        own = level.where(is_top).join(tops, "tree")
        if found is not None:
            above = found.select("tree", F.col("p").alias("up"), F.col("kids").alias("run"), "top", F.col("path").alias("on"))
            below = level.where(~is_top).withColumn("up", F.shiftright("p", 4)).join(above, ["tree", "up"])
            below = below.withColumn("path", F.concat(entry(F.col("p").bitwiseAND(F.lit(15)), F.col("run")), F.col("on")))
            own = own.unionByName(below.select(*own.columns))
        found = own.select("tree", "p", "n", "kids", "top", "path")
    one = found.select("tree", "n", "top", "path", F.col("kids.h").alias("run"), F.posexplode("kids").alias("at", "kid"))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(entry(F.col("at"), F.col("run")), F.col("path")))
    return one.select("tree", F.col("kid.h").alias("h"), F.col("kid.data").alias("data"), "top", path.alias("path"))


def numbered(tops: DataFrame) -> DataFrame:
    """``tops`` (tree, h) with the rank of the tree's name and the number of trees."""
    tops = saved(tops, "merkle_tops")
    n = tops.count()
    dealt = tops.repartitionByRange(max(1, n // SOURCES), "tree").withColumn("part", F.spark_partition_id())
    dealt = saved(dealt, "merkle_sources")  # so that the bounds are drawn once
    starts, at = [], 0
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # a row for some thousand sources
        starts.append((r["part"], at))
        at += r["count"]
    start = tops.sparkSession.createDataFrame(starts or [(0, 0)], "part int, start long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("tree")).cast("long") - 1
    return dealt.withColumn("own", place).join(start, "part").select("tree", "h", (F.col("start") + F.col("own")).alias("rank"), F.lit(n).cast("long").alias("n"))


def manifest(docs: DataFrame, data: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, data) of each row of ``docs``, which has FIELDS; ``data`` is any column of its row.

    ``path`` lists, from the leaf up, ``at``, the node's place in its run, and ``kids``, the run's digests, via the source's subroot to
    the root; it is empty for a lone row. Null fields count as ``-``; null doc_ids come first in their source, and null sources are
    one source, the first. Rows that share source and doc_id follow their leaves; repeated rows are a leaf each. Other columns
    don't count. Empty input, empty result.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))  # sorts as the sources do, null first
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), (F.lit(None).cast("string") if data is None else data).alias("data"))
    rows = rows.groupBy("tree", "doc_id", "leaf").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("data", F.struct("doc_id", "data"))
    levels, tops = climbed(ranked(rows))
    sources = numbered(tops)
    upper, root = climbed(sources.select(F.lit("all").alias("tree"), "rank", "n", "h", F.col("tree").alias("data")))
    first = root.first()
    above = root.select("tree", F.col("h").alias("top"), F.array().cast("array<struct<at:int,kids:array<string>>>").alias("path"))
    tops = proved(upper, above).select(F.col("data").alias("tree"), F.col("h").alias("top"), "path")
    out = proved(levels, tops)
    return out.select("data.doc_id", F.col("h").alias("leaf"), F.col("top").alias("subroot"), F.lit(first["h"] if first else None).cast("string").alias("root"), "path", "data.data")


def siblings(path: Column) -> Column:
    """The digests of a path but the node's own, from the leaf up."""
    return F.flatten(F.transform(path, lambda x: F.filter(x["kids"], lambda _, i: i != x["at"])))


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` and the siblings of a path give."""
    return F.aggregate(path, start, lambda h, x: joined(F.transform(x["kids"], lambda k, i: F.when(i == x["at"], h).otherwise(k))))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(lower_ascii(F.col("text"))))
    out = manifest(docs, tampered)
    out = out.withColumn("folded_root", folded(F.coalesce("data", "leaf"), F.col("path")))
    proof = F.sha2(F.array_join(siblings(F.col("path")), ""), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 6, upper: int = 3) -> str:
    """The same in DuckDB: all levels of both trees one after the other; a tree that has one node passes it on."""
    field = lambda c: f"coalesce(strlen({c})::varchar || ':' || {c}, '-')"
    h = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"
    folded_text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint), lambda c, x: list_reduce(range(8), {bit}, xor(c, x)), 4294967295::bigint), 4294967295)"
    out = [
        f"leaves AS (SELECT doc_id, source, {h('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {h(folded_text)} END AS other FROM documents)",
        "a0 AS (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, doc_id, leaf AS h, coalesce(other, leaf) AS f, leaf, '' AS proof FROM leaves)",
    ]

    def climb(names: list[str], tree: str) -> None:
        for a, b in zip(names, names[1:]):
            run = f"(PARTITION BY {tree}, p // 16)"
            lone = f"count(*) OVER (PARTITION BY {tree}) = 1"
            out.append(f"{b}k AS (SELECT *, {lone} AS lone, p // 16 AS up, list(h ORDER BY p) OVER {run} AS k FROM (SELECT DISTINCT {tree}, p, h FROM {a}))")
            others = "array_to_string(list_filter(k, lambda x, i: i <> x_p % 16 + 1), '')"
            swapped = "sha256(array_to_string(list_transform(k, lambda x, i: CASE WHEN i = x_p % 16 + 1 THEN f ELSE x END), ''))"
            cols = f"x.* EXCLUDE (p, h, f, proof), y.up AS p, CASE WHEN lone THEN x.h ELSE sha256(array_to_string(k, '')) END AS h, CASE WHEN lone THEN f ELSE {swapped.replace('x_p', 'x.p')} END AS f, proof || CASE WHEN lone THEN '' ELSE {others.replace('x_p', 'x.p')} END AS proof"
            out.append(f"{b} AS (SELECT {cols} FROM {a} x JOIN {b}k y ON x.{tree} IS NOT DISTINCT FROM y.{tree} AND x.p = y.p)")

    climb([f"a{i}" for i in range(levels + 1)], "tree")
    out.append("s AS (SELECT tree AS src, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place FROM (SELECT DISTINCT tree, h FROM a{0}))".format(levels))
    out.append(f"b0 AS (SELECT 0 AS whole, place AS p, doc_id, h, f, leaf, proof, subroot FROM a{levels} JOIN s ON tree IS NOT DISTINCT FROM src)")
    climb([f"b{i}" for i in range(upper + 1)], "whole")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM b{upper}"


OP11_SQL = _sql()
