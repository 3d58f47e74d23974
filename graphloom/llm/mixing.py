"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each document of a source has the same number of expected copies, the source's
target over its size. These are summed in an order within the source, one
random offset is added, and the document is taken once for each integer
boundary that its step crosses. The sums are 24-bit fixed-point integers, so
they do not depend on the order in which tasks add them up.

A source may hold any share of all rows, so that its prefix sum is never one
task's: the source is cut into blocks (a band of sizes, then a salt); block
totals are counted before the shuffle, their prefix sums run over the blocks,
and only the rows of one block are sorted together. Half of the rows (by hash) stand by falling
size, the other half after them by rising size: the sample is stratified by size, and what the offset
adds on the way down it takes back on the way up, which keeps the taken words near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, missing_names, saved, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
UNIT = 1 << 24
#: Rows that one block of a source holds, about.
BLOCK_ROWS = 4_096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes`` (source, source_size): one row a source. Adds ``target``.

    Sources by code point, null last, take the weights in turn. Shares of the
    whole size go by weight; a target stops at ``max_repeat`` times its source's
    size and the excess is shared again by weight. Sorted by cap over weight,
    the sources that reach their cap come first; for the i-th,
    level = (total - caps before) / (weights from i on), and the first source
    whose cap isn't below level * weight sets the level for it and all after. Levels
    fall from there on, so that it is the highest of those that qualify.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    t = t.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(every).cast("double"))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    t = t.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every))
    # no level only if rounding put each one a hair above its ratio: every source is then full
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 42, text: str = "text", source: str = "source", key: str = "doc_id", words: Column | None = None, text_hash: Column | None = None) -> DataFrame:
    """Adds size, source_size, target, copies, taken (long but target: double) to each row of ``docs``.

    ``words`` and ``text_hash`` (xxhash64 of the text) are given where they are at hand; else they are taken from ``text``.
    Null texts have size 0; sources that are null are one source, by weight the last; empty
    sources have target 0 and no copies. Ties and repeated rows are ordered by key and text hash; equal
    rows may swap their copies. Of columns that bear the added names, the added ones stay.
    An empty table gives an empty result.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    src, band, salt, tie, mass, step, rank, blk = missing_names(docs, "m_source", "m_band", "m_salt", "m_tie", "m_mass", "m_step", "m_rank", "m_block")
    sized = docs.withColumn("size", word_count(F.col(f"`{text}`")) if words is None else words).withColumn(src, F.col(f"`{source}`"))
    sized = sized.withColumn(tie, F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`")) if text_hash is None else text_hash))
    # eighth-octave bands of the size: 0 and below as sizes fall, 1 and above as they rise
    octave = F.floor(F.log2(F.col("size") + F.lit(1.0)) * -8).cast("int")
    sized = sized.withColumn(band, F.when(F.col(tie) < 0, octave).otherwise(1 - octave))
    n_by_band = sized.groupBy(src, band).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    by_source = n_by_band.groupBy(F.col(src).alias("source")).agg(F.sum("words").alias("source_size"))
    targets = source_targets(by_source, weights, max_repeat)
    fixed = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeat * UNIT), F.floor(F.col("target") / F.col("source_size") * UNIT))).otherwise(F.lit(0)).cast("long")
    targets = targets.select(F.col("source").alias("t_source"), F.col("source_size").alias("t_size"), F.col("target").alias("t_target"), fixed.alias("t_step"))
    # salts of a band: as many as its rows fill blocks
    salts = n_by_band.select(F.col(src).alias("b_source"), F.col(band).alias("b_band"), F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int").alias("b_salts"))
    sized = sized.join(salts, sized[src].eqNullSafe(salts.b_source) & (sized[band] == salts.b_band)).drop("b_source", "b_band")
    sized = sized.withColumn(salt, F.pmod(F.col(tie), F.col("b_salts"))).drop("b_salts")
    blocks = sized.groupBy(src, band, salt).agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumn("n_before", F.coalesce(F.sum("n").over(Window.partitionBy(src).orderBy(band, salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.join(targets, blocks[src].eqNullSafe(targets.t_source))
    blocks = blocks.select(F.col(src).alias("k_source"), F.col(band).alias("k_band"), F.col(salt).alias("k_salt"), "n_before", "t_size", "t_target", "t_step")
    inner = Window.partitionBy(src, band, salt).orderBy(F.when(F.col(band) <= 0, -F.col("size")).otherwise(F.col("size")), tie).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sized.withColumn(rank, F.count(F.lit(1)).over(inner))
    out = ranked.join(blocks, ranked[src].eqNullSafe(blocks.k_source) & (ranked[band] == blocks.k_band) & (ranked[salt] == blocks.k_salt))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col(src)), F.lit(UNIT))
    upto = (F.col("n_before") + F.col(rank)) * F.col("t_step") + offset
    copies = F.shiftright(upto, 24) - F.shiftright(upto - F.col("t_step"), 24)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "size", F.col("t_size").alias("source_size"), F.col("t_target").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def sizes_of(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs``, n_words and t_hash, counted once and written."""
    return saved(docs.select(*[F.col(f"`{c}`") for c in keep], word_count(F.col(f"`{text}`")).alias("n_words"), F.xxhash64(F.col(f"`{text}`")).alias("t_hash")), "mixing_sizes")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **kw) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0 to ``max_repeat`` times), columns unchanged.

    The mix is made of narrow rows; those of one source, key and text are added up, and their copies shared out evenly
    among the rows of ``docs`` that are alike, so that whole texts are dealt once.
    """
    like, body, copies, rows, nth, at = missing_names(docs, "m_like", "m_body", "m_copies", "m_rows", "m_nth", "m_at")
    sizes = sizes_of(docs, source, key, text=text)
    m = mix(sizes, text=text, source=source, key=key, words=F.col("n_words"), text_hash=F.col("t_hash"), **kw)
    same = F.xxhash64(F.lit("alike"), F.col(f"`{source}`"), F.col(f"`{key}`"))  # with the text's hash, 128 bits
    counts = m.groupBy(same.alias(like), F.col("t_hash").alias(body)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    j = docs.withColumn(like, same).withColumn(body, F.xxhash64(F.col(f"`{text}`"))).join(counts.where(F.col(copies) > 0), [like, body])
    # of r rows that are alike, c copies in all: c // r each, and one more for c % r of them
    j = j.withColumn(nth, F.row_number().over(Window.partitionBy(like, body).orderBy(F.monotonically_increasing_id())))
    each = F.floor(F.col(copies) / F.col(rows)) + (F.col(nth) <= F.col(copies) % F.col(rows)).cast("long")
    j = j.withColumn(at, F.explode(F.when(each > 0, F.sequence(F.lit(1).cast("long"), each)).otherwise(F.array().cast("array<long>"))))
    return j.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sizes_of(table(spark, sf_dir, "documents"), "doc_id", "source")
    return mix(sizes, words=F.col("n_words"), text_hash=F.col("t_hash")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
