"""Exact vector retrieval and retrieval prompts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import runs
from graphloom.operators.knn import k_nearest, knn_join

#: Rows that meet the queries of a block at once.
ROWS = 2048


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def top_k(vectors: DataFrame, query: list[float], k: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector (take-ordered: k rows of each task)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, l2(F.col(vector), q).alias("distance")).orderBy("distance", key).limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 3, key: str = "vec_id", vector: str = "embedding", most_queries: int = 4096) -> DataFrame:
    """The k nearest rows of each query: (query_id, key, distance, rank), ties by the smaller key. Up to ``most_queries`` are held by each task and meet every row; more are joined by pivots, so that rows and queries aren't all paired.

    Null vectors are at no distance from any, which ranks behind all others; those that hold nulls or are of another length than most take no part.
    """
    near = knn_join if queries.count() > most_queries else near_block
    met = near(vectors.where(F.col(vector).isNotNull()), queries.where(F.col(vector).isNotNull()), k, key, vector).select("query_id", key, "distance")
    met = met.unionByName(unmeasured(vectors, queries, k, key, vector))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), F.asc_nulls_last(key)))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def unmeasured(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """(query_id, key, distance): the pairs of a null vector that may rank: queries with the k least keys of null vectors, null queries with the k least of all."""
    least = lambda rows: F.broadcast(rows.select(key).orderBy(F.asc_nulls_last(key)).limit(k))
    q, null = F.col(key).alias("query_id"), F.col(vector).isNull()
    some = queries.where(~null).select(q).join(least(vectors.where(null)), F.lit(True))
    return some.unionByName(queries.where(null).select(q).join(least(vectors), F.lit(True))).withColumn("distance", F.lit(None).cast("double"))


def near_block(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """(query_id, key, distance) with the k nearest rows of each of a bounded set of queries, which every task holds; a task gives few more than its k nearest."""
    v = F.col(vector).cast("array<double>")
    sound = lambda df: df.select(F.col(key), v.alias("v")).where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    held = sound(queries).toArrow()
    sizes = pc.list_value_length(held["v"]).to_pylist()
    size = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    held = held.filter(pc.equal(pc.list_value_length(held["v"]), size)).combine_chunks()
    names, points = pa.array(held[key].to_pylist(), held.schema.field(key).type), matrix(held["v"].combine_chunks(), size)

    def run(batches):
        most = np.full(len(points), np.inf)
        for b in batches:
            b = b.take(pc.sort_indices(b.column(0)))  # ties go by the key
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                at, row, d = k_nearest(matrix(part.column(1), size), points, k, most)
                n = np.bincount(at, minlength=len(points))
                full = n == k
                most[full] = np.fmin(most[full], d[(np.cumsum(n) - 1)[full]])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), part.column(0).take(pa.array(row)), pa.array(d)], names=["query_id", key, "distance"])

    kind = lambda df: df.schema[key].dataType.simpleString()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # files of one row group would be one task
    return sound(vectors).where(F.size("v") == size).repartition(tasks, key).mapInArrow(run, f"query_id {kind(queries)}, `{key}` {kind(vectors)}, distance double")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of a column, each of ``size`` components."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), size) if len(column) else np.empty((0, size))


def stuffed_prompt(contexts: DataFrame, by: str, rank: str, text: str, template: str) -> DataFrame:
    """The contexts of each question by rank, joined by blank lines, in ``template`` ({context})."""
    s = F.array_sort(F.collect_list(F.struct(rank, text)))
    g = contexts.groupBy(by).agg(F.array_join(F.transform(s, lambda x: x[text]), "\n\n").alias("context"))
    return g.select(by, F.replace(F.lit(template), F.lit("{context}"), F.col("context")).alias("prompt"))


def expanded(hits: DataFrame, chunks: DataFrame, size: int = 250, key: str = "chunk_id", source: str = "source", length: str = "n_chars", score: str = "score", most_score: float | None = None) -> DataFrame:
    """(source, run_start, run_end, n, score): hits (key, source, score) with their neighbours in the source, joined to runs of consecutive ids.

    Neighbours are taken nearest first, the earlier of two first, until one would make the texts longer than ``size``; the hit itself always stays.
    A run's score is the least of its hits'; hits beyond ``most_score`` are left out. Chunks have a character at least, so that ``size`` ids on either side are enough: both sides meet by blocks of that many ids.
    """
    hits = hits if most_score is None else hits.where(F.col(score) <= most_score)
    h = hits.select(F.col(key).alias("h_id"), F.col(source).alias("h_source"), F.col(score).alias("score"))
    h = h.withColumn("b", F.explode(F.sequence(F.floor((F.col("h_id") - size) / size), F.floor((F.col("h_id") + size) / size))))
    c = chunks.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(length).alias("len")).withColumn("c_b", F.floor(F.col("id") / size))
    near = h.join(c, (F.col("b") == F.col("c_b")) & (F.col("h_source") == F.col("source"))).where(F.abs(F.col("id") - F.col("h_id")) <= size)
    w = Window.partitionBy("source", "h_id").orderBy(F.abs(F.col("id") - F.col("h_id")), "id").rowsBetween(Window.unboundedPreceding, 0)
    taken = near.withColumn("sum", F.sum("len").over(w)).where((F.col("sum") <= size) | (F.col("id") == F.col("h_id")))
    return runs(taken, ["source"], "id", "score")


def record_chunks(records: DataFrame, key: str) -> DataFrame:
    """(key, text): each record as one chunk, its JSON, nulls included."""
    return records.select(key, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("text"))


def packed_sentences(sentences: Column, size: int, separator: str = " ") -> Column:
    """Sentences joined in order to chunks of ``size`` characters at most; a longer one is a chunk of its own. Null: null."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    room = lambda s, x: F.length(s["open"]) + len(separator) + F.length(x) <= size
    add = lambda s, x: F.when(s["open"] == "", F.struct(s["done"].alias("done"), x.alias("open"))).when(room(s, x), F.struct(s["done"].alias("done"), F.concat(s["open"], F.lit(separator), x).alias("open"))).otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), x.alias("open")))
    return F.aggregate(sentences, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
