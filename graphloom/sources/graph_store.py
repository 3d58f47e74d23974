"""The graph as bucketed tables: nodes by their key, edges by head and again by tail, so that joins of a pattern deal no stored table anew."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.files import exists


@dataclass
class StoredGraph:
    """``nodes`` by label, edges (with a column ``rel``) bucketed by ``src`` (``out``) and by ``dst`` (``back``)."""

    nodes: dict[str, DataFrame]
    out: DataFrame
    back: DataFrame

    def edges(self, rel: str | None = None, back: bool = False) -> DataFrame:
        """The edges of a relation (of all, without one), as a step in that direction reads them."""
        e = self.back if back else self.out
        return e if rel is None else e.where(F.col("rel") == rel)


def write_buckets(nodes: dict[str, DataFrame], keys: dict[str, str], edges: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes the graph in place of what is at ``path``: every table in ``buckets`` buckets, sorted within each by its key.

    Labels without a key in ``keys`` are written as they are. A bucket's rows are gathered by a task each, so that it has one file; buckets are to be chosen by the tables' size.
    """
    spark = edges.sparkSession
    tables = {f"nodes_{l}": (df, keys.get(l)) for l, df in nodes.items()} | {"edges_out": (edges, "src"), "edges_back": (edges, "dst")}
    told = {}
    for name, (df, key) in tables.items():
        told[name] = {"schema": df.schema.simpleString()[len("struct<") : -1], "key": key, "ddl": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
        if key is None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            continue
        own = f"graph_{uuid.uuid4().hex}"
        w = df.repartition(buckets, F.col(key)).write.mode("overwrite").option("path", f"{path}/{name}")
        w.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(own)
        spark.sql(f"DROP TABLE {own}")  # the files stay: the table is an external one
    spec = {"buckets": buckets, "labels": list(nodes), "tables": told}
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def open_buckets(spark: SparkSession, path: str) -> StoredGraph:
    """The graph that ``write_buckets`` has written, also by another session."""
    if not exists(spark, f"{path}/spec"):
        raise FileNotFoundError(f"no graph at {path}")
    spec = json.loads(spark.read.text(f"{path}/spec", wholetext=True).first()[0])

    def opened(name: str) -> DataFrame:
        t = spec["tables"][name]
        if t["key"] is None:
            return spark.read.schema(t["ddl"]).parquet(f"{path}/{name}")
        own = f"graph_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {own} ({t['ddl']}) USING parquet CLUSTERED BY (`{t['key']}`) SORTED BY (`{t['key']}`) INTO {spec['buckets']} BUCKETS LOCATION '{path}/{name}'")
        return spark.table(own)

    return StoredGraph({l: opened(f"nodes_{l}") for l in spec["labels"]}, opened("edges_out"), opened("edges_back"))
