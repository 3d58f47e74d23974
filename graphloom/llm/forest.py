"""Approximate nearest neighbours by a hash-prefix forest.

A vector's hash in a tree is a long string of sign bits of random projections; each tree
is the sorted array of these strings. A query descends by binary search to the rows that share
its longest prefix, then ascends in all trees at once, one bit at a time, until enough
candidates have been seen; these are scored by exact inner products.

Rows are dealt to shards of about ``SHARD_ROWS`` (by hash of their number), each with a whole forest. The queries are dealt to
blocks of about ``QUERY_BLOCK``, and each block meets each shard in a group of its own, so that a group holds a shard and a block,
whatever the input; a query's answers of all shards are merged. A level's whole prefix range is taken, so that candidates have no
cap. Work is queries times rows by ``SHARE``.

Largest inner product is turned into largest cosine by one more component,
sqrt(M^2 - |x|^2) with M the greatest norm, 0 for queries; only hashing uses it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import saved, table

TREES = 64
BITS = 32
#: The share of a shard's rows at which a query's ascent ends.
SHARE = 0.45
SHARD_ROWS = 16_384
#: Queries of a block, about, and of one step within it.
QUERY_BLOCK, QUERY_STEP = 8_192, 1_024
TOP = 20


class Forest:
    """Sorted hash strings of the rows ``x``, a tree for each set of projections."""

    def __init__(self, x: np.ndarray, most_norm: float, trees: int = TREES, bits: int = BITS, seed: int = 42):
        assert bits <= 62
        self.bits, self.n = bits, len(x)
        rng = np.random.default_rng(seed)
        self.planes = [rng.standard_normal((x.shape[1] + 1, bits)) for _ in range(trees)]
        slack = np.sqrt(np.maximum(0.0, most_norm**2 - (x * x).sum(axis=1)))
        codes = [self.code(np.column_stack([x, slack]), p) for p in self.planes]
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes]
        self.sorted = [c[o] for c, o in zip(codes, self.order)]

    def code(self, x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return (x @ planes > 0) @ (np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def candidates(self, q: np.ndarray, enough: int):
        """For each row of ``q`` the sorted indexes that the ascent has reached."""
        q = np.column_stack([q, np.zeros(len(q))])
        codes = [self.code(q, p) for p in self.planes]
        levels = range(self.bits, -1, -1)
        low = np.empty((self.bits + 1, len(codes), len(q)), np.int32)
        high = np.empty_like(low)
        for x in levels:
            rest = np.int64(self.bits - x)
            for t, c in enumerate(codes):
                p = (c >> rest) << rest
                low[x, t], high[x, t] = np.searchsorted(self.sorted[t], p), np.searchsorted(self.sorted[t], p + (np.int64(1) << rest))
        reach = (high - low).sum(axis=1)
        for i in range(len(q)):
            seen = np.zeros(self.n, bool)
            for x in levels:
                if x and reach[x, i] < enough:
                    continue  # the trees together haven't enough, even without repeats
                for t in range(len(codes)):
                    seen[self.order[t][low[x, t, i] : high[x, t, i]]] = True
                found = np.flatnonzero(seen)
                if len(found) >= enough or not x:
                    break
            yield found


def searched(shards: DataFrame, queries: DataFrame, most_norm: float, top: int, trees: int, bits: int, share: float) -> DataFrame:
    """The best ``top`` of each shard: (query_row, query_id, vec_id, score). ``shards``: (shard, block, row, vec_id, v); ``queries``: (q_shard, q_block, query_row, query_id, q)."""

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return empty()
        ids, rows, x = left.column("vec_id").to_numpy(), left.column("row").to_numpy(), stacked(left.column("v"))
        order = np.lexsort((rows, ids))
        ids, rows, x = ids[order], rows[order], x[order]
        forest = Forest(x, most_norm, trees, bits)
        qi, qr, qv = right.column("query_id").to_numpy(), right.column("query_row").to_numpy(), stacked(right.column("q"))
        enough = max(2 * (top + 1), int(np.ceil(share * len(ids))))
        out: list = []
        for at in range(0, len(qi), QUERY_STEP):
            own, name, v = qr[at : at + QUERY_STEP], qi[at : at + QUERY_STEP], qv[at : at + QUERY_STEP]
            for k, found in enumerate(forest.candidates(v, enough)):
                found = found[rows[found] != own[k]]
                score = x[found] @ v[k]
                if len(found) > top:
                    least = np.partition(score, len(score) - top)[len(score) - top]
                    found, score = found[score >= least], score[score >= least]
                best = np.lexsort((ids[found], -score))[:top]
                out.append((np.full(len(best), own[k]), np.full(len(best), name[k]), ids[found[best]], score[best]))
        return pa.table([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], names=names)

    names = ["query_row", "query_id", "vec_id", "score"]

    def empty():
        return pa.table([*[pa.array([], pa.int64())] * 3, pa.array([], pa.float64())], names=names)

    def stacked(column) -> np.ndarray:
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1).astype(np.float64)

    return shards.groupBy("shard", "block").cogroup(queries.groupBy("q_shard", "q_block")).applyInArrow(run, "query_row long, query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 20, top: int = TOP, trees: int = TREES, bits: int = BITS, share: float = SHARE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``top`` nearest found of each row whose vec_id is divisible by ``every``: (query_id, rank, vec_id, score).

    ``vectors``: vec_id, embedding (array of numbers). Vectors that are null, zero, hold null or non-finite components, or
    have not the most common length take no part, nor do rows with null vec_ids. Ties go to the smaller vec_id. Rows
    that share a vec_id are rows of their own, each a candidate and, if divisible, a query with answers of its own. Empty input, empty result.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda c: c != 0))
    v = saved(v.withColumn("row", F.monotonically_increasing_id()), "forest_vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).orderBy(F.desc("n"), "d").first()
    dim, n, most = (sizes["d"], sizes["n"], sizes["m"]) if sizes else (0, 0, 0.0)
    v = v.where(F.size("v") == dim)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-(n // every) // QUERY_BLOCK))
    every_one = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = v.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("block", every_one(blocks))
    asked = v.where(F.col("vec_id") % every == 0).select(F.pmod(F.xxhash64(F.lit("block"), "row"), F.lit(blocks)).cast("int").alias("q_block"), F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = asked.withColumn("q_shard", every_one(shards))  # columns of their own: of shared ones a pruned plan would lose one side's
    found = searched(dealt, asked, float(most), top, trees, bits, share)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
