"""Vectors of texts from a model that the caller gives, kept with the texts' hashes so that only new and changed texts are embedded again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from graphloom.sources.files import exists

Model = Callable[[list[str]], np.ndarray]


def embedded(docs: DataFrame, key: str, text: str, load: Callable[[], Model], size: int, batch: int = 256) -> DataFrame:
    """(key, text_hash, embedding): a vector of ``size`` doubles for each text, null texts as empty. ``load`` runs once a task and gives the function of at most ``batch`` texts; another shape of its result is an error."""
    schema = StructType([docs.schema[key], StructField("text_hash", StringType()), StructField("embedding", ArrayType(DoubleType()))])
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.sha2("t", 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                v = np.asarray(model(part["t"].tolist()), np.float64)
                if v.shape != (len(part), size):
                    raise ValueError(f"the model gave {v.shape} for {len(part)} texts, not vectors of {size}")
                yield pd.DataFrame({key: part["k"].to_numpy(), "text_hash": part["h"].to_numpy(), "embedding": list(v)})

    return rows.mapInPandas(run, schema)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, text_hash, embedding) of the index at ``path``: of each key the row of its last generation, unless that marks it as gone. None without an index."""
    if not exists(spark, path):
        return None
    t = spark.read.parquet(path)
    key = next(c for c in t.columns if c not in ("text_hash", "embedding", "generation"))
    last = t.groupBy(key).agg(F.max_by(F.struct("text_hash", "embedding"), "generation").alias("l"))
    return last.where("l.text_hash is not null").select(key, "l.text_hash", "l.embedding")


def generations(spark: SparkSession, path: str) -> int:
    """The number of the last generation at ``path``, 0 without one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []  # a folder a run
    return max([int(n.split("=")[1]) for n in names if n.startswith("generation=")], default=0)


def refreshed(spark: SparkSession, path: str, docs: DataFrame, key: str, text: str, load: Callable[[], Model], size: int, batch: int = 256) -> DataFrame:
    """The index at ``path`` brought up to ``docs`` and read again: (key, text_hash, embedding).

    Only keys that are new or whose text's hash has changed are embedded; keys that ``docs`` lacks are marked as gone. A run writes what has changed as one more generation, beside
    those that are there, so that readers see either the index before or after it; a run without a change writes none. Of rows that share a key the one with the least hash counts; null keys go.
    """
    now = docs.where(F.col(key).isNotNull()).withColumn("n_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    now = now.groupBy(key).agg(F.min(F.struct("n_hash", F.col(text).alias("t"))).alias("n")).select(key, "n.n_hash", "n.t")
    before = stored(spark, path)
    n = generations(spark, path) + 1
    if before is None:
        changed, gone = now, None
    else:
        old = before.select(key, "text_hash")
        both = now.join(old, key, "full_outer")
        changed = both.where("n_hash is not null and not (n_hash <=> text_hash)").select(key, "t")
        gone = both.where("n_hash is null").select(key, F.lit(None).cast("string").alias("text_hash"), F.lit(None).cast("array<double>").alias("embedding"))
    out = embedded(changed.select(key, "t"), key, "t", load, size, batch)
    out = out if gone is None else out.unionByName(gone)
    if before is None or not both.where("not (n_hash <=> text_hash)").isEmpty():
        out.write.mode("overwrite").parquet(f"{path}/generation={n:08d}")
    return stored(spark, path)


def compacted(spark: SparkSession, path: str, target: str) -> None:
    """The index at ``path`` as a single generation at ``target``, another folder."""
    stored(spark, path).write.mode("overwrite").parquet(f"{target}/generation={1:08d}")
