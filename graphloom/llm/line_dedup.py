"""Line dedup by an exact set-similarity join (DataFrame functions only).

A line's tokens are its distinct shingles of five words (lines of fewer words have none and match equal ones alone), compared as 64-bit
hashes. A line is removed if an earlier line of the corpus, by (doc_id, line number), has a
Jaccard similarity of at least 0.8 to it, whether that one stays or goes.

1. Rarity: tokens are counted over a sample of documents; the order is by the class of the most frequent token of a token's bucket, then by hash.
   Any order finds the same lines, so that the sample bears on the time alone. The table has a fixed size.
2. Lines of equal words (by 128 bits) are one node, whose first line may stay.
3. Prefix filter: only the first n - ceil(0.8 n) + 2 tokens of a node are dealt by token, and the rows of very hot ones to as many
   groups as their counts ask for, up to 64.
   Lines that hold a share of all lines are cut to their first before that.
4. Each node meets the earliest one of its group first; these of a hot token meet the earliest of all. Only nodes that match
   neither meet the others, so that a family of copies costs a pair a node, not all pairs. Length and positional filters come before any pair is made,
   and nodes that share a frequent token meet only if they share a second one.
5. Pairs are verified on whole token sets, made again for these lines alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, missing_names, saved, table
from graphloom.llm.shingles import HotTokens, Rarity

SHINGLE = 5
#: A node with over 1 / HOT_SHARE of all lines (so HOT_SHARE nodes at most) is cut to its first line before the deal.
HOT_SHARE = 10_000
#: A token's rows are dealt to 2^(c - SALT_FROM) groups, 64 at most, where its count is 2^c times the least hot one: to groups of about 8,192 rows.
SALT_FROM, SALT_BITS = 8, 6
#: Rows of a token from which on the sizes and places of all decide whether a row meets the others.
MANY = 64
#: Rows of a token from which on nodes meet by two tokens, and the most tokens of a line that does.
GROUP, LONG = 16, 256
#: Longs of a membership bitmap, of 63 bits each: about 16 bits a member, within these bounds.
FILTER_WORDS = (1 << 8, 1 << 18)
#: Documents that the order of tokens is counted on, about; buckets of its table, and the most tokens that it is made of.
SAMPLE, BUCKETS, MOST = 1 << 12, 1 << 16, 1 << 14
#: Jaccard similarity of at least NUM / DEN.
NUM, DEN = 4, 5
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(did, dh, t): ``dh`` tells documents of one doc_id apart; null doc_ids come last, null texts are empty."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(t).alias("dh"), t.alias("t"))


def need(n):
    """ceil(NUM n / DEN): the least tokens that a match of a node of n tokens shares with it."""
    return (n * NUM + (DEN - 1)) // DEN


def need_column(n: Column) -> Column:
    return F.floor((n * NUM + (DEN - 1)) / DEN).cast("int")


def overlap(a: Column, b: Column) -> Column:
    """ceil(s / (1 + s) (a + b)): the least shared tokens of two nodes of a and b tokens that match."""
    return F.floor(((a + b) * NUM + (NUM + DEN - 1)) / (NUM + DEN)).cast("int")


def fits(x: str, y: str, first_shared: bool) -> Column:
    """Length filter, then the positional filter: what two nodes can share, given the places of a shared token.

    With ``first_shared`` the token counts as the first that the two share, as it is in one of the places where a matching pair meets.
    """
    n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    return fitting(n, m, i, j, F.lit(1) if first_shared else F.least(i, j))


def fitting(n: Column, m: Column, i: Column, j: Column, upto: Column) -> Column:
    """Whether nodes of n and m tokens with a shared one at places i and j, at most the ``upto``-th that they share, can match."""
    return (m >= need_column(n)) & (n >= need_column(m)) & (upto + F.least(n - i, m - j) >= overlap(n, m))


def member_filter(rows: DataFrame, *names: str) -> Column:
    """A test of columns ``names`` that passes all of ``rows`` and few others, while these are few: a bitmap of at most FILTER_WORDS longs."""
    least, most = FILTER_WORDS
    size = max(least, min(most, rows.count() * 16 // 63))
    h = F.pmod(F.xxhash64(*names), F.lit(size * 63))
    words = rows.select(h.alias("h")).groupBy(F.floor(F.col("h") / 63).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 63 as int))")).alias("v"))
    told = words.toArrow()  # ``size`` rows at most, in one job: a job a partition would fill the driver
    bits = np.zeros(size, np.int64)
    bits[told["w"].to_numpy()] = told["v"].to_numpy()
    one = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(bits))
    held = rows.sparkSession.createDataFrame(pa.table({"bits": one})).scalar()
    return F.call_function("shiftright", F.get(held, F.floor(h / 63).cast("int")), (h % 63).cast("int")).bitwiseAND(F.lit(1)) == 1


def with_words(docs: DataFrame) -> DataFrame:
    """(did, dh, line_no, words): the lines of ``docs`` (did, dh, t) that hold words.

    Lines are cut at single spaces without a pattern; those that hold other ASCII white space are cut by one.
    Through explode, beneath which no filter is pushed: else an expression on words would cut the line anew each time.
    """
    rows = docs.select("did", "dh", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    other = F.lit(False)
    for space in "\t\x0b\x0c\r":
        other = other | F.contains("line", F.lit(space))
    cut = F.when(other, F.split("line", r"[\x20\x09-\x0D]+")).otherwise(F.split("line", " "))
    return rows.select("did", "dh", "line_no", F.explode(F.array(F.array_remove(cut, ""))).alias("words")).where(F.size("words") > 0)


def shingle_at(i: Column, shingle: int) -> Column:
    """The hash of the shingle of ``words`` that begins with word ``i`` (from 0), made of its words' hashes."""
    return F.xxhash64(*[F.xxhash64(F.get("words", i + k)) for k in range(shingle)])


def last_shingle(shingle: int) -> Column:
    return F.size("words") - shingle


def tokens(shingle: int) -> Column:
    """The distinct hashes of the shingles of ``words``, none of fewer words."""
    # each word is hashed once; all hashes are one element, so that they are held while the shingles are made
    hashes = F.array(F.transform("words", lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(0), last_shingle(shingle))
    toks = F.array_distinct(F.flatten(F.transform(hashes, lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)])))))
    return F.when(last_shingle(shingle) >= 0, toks).otherwise(F.array().cast("array<long>"))


def scanned(docs: DataFrame, classes: Column, shingle: int) -> DataFrame:
    """A row for each line with words: its place, ``lid``, ``lid2``, the 128 bits of its words, ``n``, its number of tokens, and ``pre``, its first n - ceil(0.8 n) + 2 tokens in order."""
    # the class above the hash's upper 56 bits, so that the order of rarity is the order of numbers
    order = lambda t: F.get(classes, t.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).bitwiseOR(F.shiftrightunsigned(t, 8))
    rows = with_words(docs).select("did", "dh", "line_no", F.xxhash64("words").alias("lid"), F.xxhash64(F.lit(1), "words").alias("lid2"), F.explode(F.array(F.transform(tokens(shingle), order))).alias("toks"))
    n = F.size("toks")
    return rows.select("did", "dh", "line_no", "lid", "lid2", n.alias("n"), F.slice(F.sort_array("toks"), F.lit(1), n - need_column(n) + 2).alias("pre"))


def order_of(docs: DataFrame, shingle: int) -> Column:
    """The classes of the tokens' buckets in the upper byte, an array of BUCKETS: COMMON, or four above that for each doubling of the estimated number of different lines that hold its most frequent token over the least hot one."""
    share = max(1, docs.count() // SAMPLE)
    rows = with_words(docs.where(F.pmod("dh", F.lit(share)) == 0)).where(last_shingle(shingle) >= 0)
    rows = rows.withColumn("lid", F.xxhash64("words")).dropDuplicates(["lid"])  # copies of a line are one node
    counted = rows.select("words", F.explode(F.sequence(F.lit(0), last_shingle(shingle))).alias("i")).select(shingle_at(F.col("i"), shingle).alias("t")).groupBy("t").count()
    counted = counted.where("count > 1").withColumn("seen", F.col("count") * share)
    often = counted.groupBy(F.col("t").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.max("seen").alias("seen")).orderBy(F.desc("seen"), "b").limit(MOST).collect()  # MOST rows
    classes = [Rarity.COMMON] * BUCKETS
    for r in often:
        classes[r["b"]] = min(127, Rarity.COMMON + 1 + int(4 * np.log2(max(r["seen"] / Rarity.LEAST, 1))))
    return F.split(F.lit(",".join(str(c << 56) for c in classes)), ",").cast("array<long>")  # folded to one literal


def rarity(found: DataFrame) -> Rarity:
    """The order of the tokens, by ``found`` of all tasks."""
    buckets = np.zeros(HotTokens.BUCKETS, np.int64)
    for r in found.where("buckets is not null").select(F.posexplode("buckets").alias("b", "c")).groupBy("b").agg(F.sum("c").alias("c")).collect():  # a row a bucket
        buckets[r["b"]] = r["c"]
    least = max(Rarity.LEAST, int(buckets.sum()) // Rarity.SHARE)
    hot = found.where("tok is not null").groupBy("tok").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least).orderBy(F.desc("seen"), "tok").limit(Rarity.MOST)  # one left out stays in its bucket's class
    return Rarity([(r["tok"], r["seen"]) for r in hot.collect()], buckets)


def salt_bits(classes: np.ndarray) -> np.ndarray:
    """The bits of the salt of tokens of ``classes``; see ``Rarity``."""
    return np.clip((classes - Rarity.COMMON - 1) // 4 - SALT_FROM, 0, SALT_BITS).astype(np.uint64)


def prefixes(found: DataFrame, cut: DataFrame) -> DataFrame:
    """(g, lid, did, np) of the prefix tokens of each line: ``g`` is the token, with a salt in the low bits if it is very hot, ``np`` the number of tokens and the place. ``cut``: the first places of nodes of which only these are dealt."""
    rows = found.where("n > 0").join(F.broadcast(cut), ["lid"], "left").where("first is null or struct(did, dh, line_no) = first")  # HOT_SHARE rows at most
    rows = rows.select("did", "lid", "n", F.posexplode("pre").alias("i", "tok"))
    bits = salt_column("tok")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    g = F.when(bits > 0, F.col("tok").bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.col("lid").bitwiseAND(low))).otherwise(F.col("tok"))
    return rows.select(g.alias("g"), "lid", "did", (F.col("n") * F.lit(1 << 32) + F.col("i") + 1).alias("np"))


def salt_column(tok: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(SALT_BITS), F.floor((F.shiftright(tok, 56) - (Rarity.COMMON + 1)) / 4).cast("int") - SALT_FROM))


def removed_nodes(docs: DataFrame, found: DataFrame, nodes: DataFrame, cut: DataFrame, shingle: int) -> DataFrame:
    """(g_first): the first places of the nodes that an earlier one matches."""
    p = prefixes(found, cut)
    by = Window.partitionBy("g")
    bits = salt_column("g")
    # a salted token's groups meet one another, so that one of a single node counts too
    p = p.withColumn("least", F.min("lid").over(by)).withColumn("last", F.max("lid").over(by)).where((F.col("last") != F.col("least")) | (bits > 0)).drop("least", "last")
    p = p.withColumn("lead", F.min(F.struct("did", "lid", "np")).over(by)).groupBy("g", "lid", "np").agg(F.first("lead").alias("lead"), F.min("did").alias("did"))
    split = lambda lid, c: F.struct(F.col(lid).alias("lid"), F.shiftright(c, 32).cast("int").alias("n"), F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))
    tok = F.call_function("shiftleft", F.call_function("shiftright", F.col("g"), bits), bits)
    shared = saved(p.select(tok.alias("tok"), split("lid", "np").alias("x"), split("lead.lid", "lead.np").alias("y"), "did", F.col("lead.did").alias("lead_did"), (bits > 0).alias("hot")), "line_shared")

    # the earliest of each group of a salted token meet the earliest of all
    leads = shared.where("hot").select("tok", "y", "lead_did").distinct()
    top = leads.groupBy("tok").agg(F.min(F.struct("lead_did", "y"))["y"].alias("top")).withColumnRenamed("tok", "t_tok")
    meet = shared.select("x", "y").unionByName(leads.join(top, F.col("tok") == F.col("t_tok")).select(F.col("y").alias("x"), F.col("top").alias("y")))
    meet = meet.where("x.lid <> y.lid").where(fits("x", "y", False)).select(F.col("x.lid").alias("u"), F.col("y.lid").alias("v")).distinct()
    met = matches(docs, nodes, meet, shingle)

    left = shared.join(met.select(F.col("g_lid")).distinct(), F.col("x.lid") == F.col("g_lid"), "left_anti")
    more = saved(later_pairs(left.select("tok", "x", "y", "did"), shared.select("tok", F.col("x").alias("z"), F.col("did").alias("z_did"))), "line_more")
    out = met.unionByName(matches(docs, nodes, more, shingle)).select("g_first").distinct()
    dropped(more)
    return out


def later_pairs(left: DataFrame, others: DataFrame) -> DataFrame:
    """(u, v) of nodes that may match: x of ``left`` (tok, x, y, did) and z, none later, of ``others`` (tok, z, z_did), which share a token.

    Of a token of GROUP rows or more, nodes meet only if they share a second one of their prefixes, as all matches of more than one token do (for which a prefix
    has one token more than the first needs): a frequent phrase alone makes no pairs. A line of over LONG tokens has too many twos of tokens: these few meet by one.
    """
    sizes = others.groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
    big = sizes.where(F.col("c") >= GROUP).select("tok")
    named = lambda rows: rows.select(F.greatest("x.lid", "z.lid").alias("u"), F.least("x.lid", "z.lid").alias("v"))
    new = F.expr("z_did <= did and x.lid <> z.lid and z.lid <> y.lid")
    few = others.join(sizes.where(F.col("c") < GROUP).select("tok"), "tok")
    few = named(left.join(few, "tok").where(new & fits("x", "z", True)))

    many = others.join(big, "tok")
    xs = saved(promising(left.join(big, "tok"), many), "line_left")
    zs = many.join(xs.select("tok").distinct(), "tok", "left_semi")
    alone = lambda c: (F.col(f"{c}.n") > LONG * NUM // DEN) | (F.col(f"{c}.n") == 1)
    by_one = xs.where(alone("x")).join(zs.where(alone("z")), "tok").where(new & fits("x", "z", True))
    by_one = named(by_one.where((F.greatest("x.n", "z.n") > LONG) | (F.greatest("x.n", "z.n") == 1)))

    seconds = others.where(F.col("z.n") <= LONG).select(F.col("z.lid").alias("s_lid"), F.col("tok").alias("second"), F.col("z.pos").alias("s_pos"))
    twos = lambda rows, c: rows.where(F.col(f"{c}.n") <= LONG).join(seconds, F.col(f"{c}.lid") == F.col("s_lid")).where(F.col("s_pos") > F.col(f"{c}.pos")).drop("s_lid").withColumnRenamed("s_pos", f"{c}_second")
    n, m, left_over = F.col("x.n"), F.col("z.n"), F.least(F.col("x.n") - F.col("x_second"), F.col("z.n") - F.col("z_second"))
    by_two = twos(xs, "x").join(twos(zs, "z"), ["tok", "second"]).where(new & fits("x", "z", True) & (left_over + 2 >= overlap(n, m)))
    return few.unionByName(by_one).unionByName(named(by_two)).distinct()


def promising(rows: DataFrame, others: DataFrame) -> DataFrame:
    """``rows`` (tok, x) without those that fit none of ``others`` (tok, z) of their token, where these are MANY: told by the sizes and places that occur, not by the rows.

    Variants of a template share tokens behind those that tell them apart: there, nothing that fits is left of a group, and its rows never meet.
    """
    many = others.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= MANY).select("tok")
    kinds = others.join(many, "tok").select("tok", "z.n", "z.pos").distinct().groupBy("tok").agg(F.collect_list(F.struct("n", "pos")).alias("kinds"))
    fit = F.exists("kinds", lambda k: fitting(F.col("x.n"), k["n"], F.col("x.pos"), k["pos"], F.lit(1)))
    return rows.join(kinds, "tok", "left").where(F.col("kinds").isNull() | fit).drop("kinds")


def matches(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(g_first, g_lid): the first place of the later node of each of ``pairs`` (u, v: lids) whose token sets have the similarity. Only lines of pairs are cut into tokens."""
    place = lambda name: nodes.select(F.col("lid").alias(f"{name}_lid"), F.struct("first", "lid").alias(name))
    two = pairs.join(place("a"), F.col("u") == F.col("a_lid")).join(place("b"), F.col("v") == F.col("b_lid")).where("a.first <> b.first")
    two = two.select(F.greatest("a", "b").alias("later"), F.least("a.first", "b.first").alias("b"))
    two = saved(two.select(F.col("later.first").alias("a"), "b", F.col("later.lid").alias("g_lid")).distinct(), "line_pairs")
    wanted = saved(two.select(F.explode(F.array("a", "b")).alias("at")).select("at.*").distinct(), "line_wanted")
    some = with_words(docs.where(member_filter(wanted, "did", "dh"))).where(member_filter(wanted, "did", "dh", "line_no")).join(wanted, ["did", "dh", "line_no"], "left_semi")
    # rows that repeat a document are one
    sets = saved(some.dropDuplicates(["did", "dh", "line_no"]).select(F.struct("did", "dh", "line_no").alias("at"), tokens(shingle).alias("toks")), "line_sets")
    both = two.join(sets.select(F.col("at").alias("a"), F.col("toks").alias("ta")), "a").join(sets.select(F.col("at").alias("b"), F.col("toks").alias("tb")), "b")
    same = F.size(F.array_intersect("ta", "tb"))
    good = same * DEN >= (F.size("ta") + F.size("tb") - same) * NUM
    out = saved(both.where(good).select(F.col("a").alias("g_first"), "g_lid").distinct(), "line_matches")
    dropped(two, wanted, sets)
    return out


def removed_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(did, dh, line_no) of every line to remove."""
    rows = keyed(docs, text, key)
    found = saved(scanned(rows, order_of(rows, shingle), shingle), "line_places")
    nodes = found.groupBy("lid", "lid2").agg(F.min(F.struct("did", "dh", "line_no")).alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = saved(nodes, "line_nodes")
    n_lines = nodes.agg(F.sum("copies")).first()[0] or 0
    often = nodes.where(F.col("copies") > max(1, n_lines // HOT_SHARE)).groupBy("lid").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("c"))
    cut = often.where("c = 1").select("lid", "first")  # HOT_SHARE rows at most
    gone = removed_nodes(rows, found, nodes, cut, shingle)
    judged = nodes.join(gone, F.col("first") == F.col("g_first"), "left").where("copies > 1 or g_first is not null")
    judged = judged.select(F.col("lid").alias("j_lid"), F.col("lid2").alias("j_lid2"), "first", F.col("g_first").isNotNull().alias("gone"))
    out = found.join(judged, (F.col("lid") == F.col("j_lid")) & (F.col("lid2") == F.col("j_lid2"))).where("gone or struct(did, dh, line_no) <> first")
    return out.select("did", "dh", "line_no").distinct()


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the removed lines cut from ``text``, and n_lines, n_removed (int).

    Null texts stay null and have one line; lines without words always stay. Rows that repeat a
    doc_id and text are one document and are cut alike; null doc_ids come last in the order. Of columns that
    bear the added names, the added ones stay. Empty input, empty result.
    """
    docs = docs.drop("n_lines", "n_removed")
    a, b, no, did, dh, cut = missing_names(docs, "r_did", "r_dh", "r_no", "r_key", "r_hash", "r_cut")
    gone = removed_lines(docs, text, key, shingle).groupBy(F.col("did").alias(a), F.col("dh").alias(b)).agg(F.sort_array(F.collect_list("line_no")).alias(no))  # lines of one document
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.withColumn(did, F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID))).withColumn(dh, F.xxhash64(t))
    j = rows.join(gone, (F.col(did) == F.col(a)) & (F.col(dh) == F.col(b)), "left")
    # whether each line up to the last removed one goes: a false for each line between two of the sorted numbers; made once, through explode
    gaps = F.transform(F.col(no), lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get(F.col(no), i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
    j = j.withColumn(cut, F.explode(F.array(F.struct(F.split(t, "\n").alias("lines"), F.flatten(gaps).alias("goes")))))
    kept = F.array_join(F.filter(F.col(cut)["lines"], lambda x, i: ~F.coalesce(F.get(F.col(cut)["goes"], i), F.lit(False))), "\n")
    out = j.withColumn("n_lines", F.size(F.col(cut)["lines"])).withColumn("n_removed", F.coalesce(F.when(F.col(no).isNotNull(), F.size(no)), F.lit(0)))
    return out.withColumn(text, F.when(F.col(no).isNull(), F.col(f"`{text}`")).otherwise(kept)).drop(a, b, no, did, dh, cut)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", (F.col("n_lines") - F.col("n_removed")).alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
