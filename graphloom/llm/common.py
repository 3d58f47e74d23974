"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Used only where the session names no shared folder (tests, one machine).
OWN_CHECKPOINT_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share; sets one where none is named."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = OWN_CHECKPOINT_DIR
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Holds the scratch paths that are given while it is open (``with``), until ``close`` deletes them: for a caller that has saved what its lazy result reads.

    Each call has its own, so that no call deletes what another's result still reads. Paths outside any are deleted with the session, as are those never closed.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self._before = _open.set(self)
        return self

    def __exit__(self, *_) -> None:
        _open.reset(self._before)

    def close(self) -> None:
        paths, self.paths = self.paths, []
        for p in paths:
            deleted(self.spark, p)


_open: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, which goes when the session's JVM ends, at the latest."""
    path = f"{shared_dir(spark)}/{what}_{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)  # only what exists can be noted
    fs.deleteOnExit(p)
    if (held := _open.get()) is not None:
        held.paths.append(path)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``saved`` wrote for ``tables``, once nothing reads them any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            deleted(df.sparkSession, files[0].rsplit("/", 1)[0])


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the rows of an Arrow batch, so that long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for what is run within; the session's own setting holds again after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_hash_base() -> int:
    return 0x9E3779B97F4A7C15 | 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser over uint64; bijective."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def missing_names(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of ``df`` bears (compared without case), so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))
