"""Sources and sinks: HTML trees, JSON, schema files, vocabularies, caches, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import indexed


def html_tree(spark: SparkSession, path: str) -> DataFrame:
    """(group, path, html) of every .html file; the group is the top-level file or directory of that name."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(path)
    rel = F.substring_index("path", path.rstrip("/") + "/", -1)
    return f.select(F.regexp_replace(F.substring_index(rel, "/", 1), r"\.html$", "").alias("group"), "path", F.decode("content", "UTF-8").alias("html"))


def groups_with(pages: DataFrame, tags: list[str] | None, tag_column: str = "tag", limit: int | None = None) -> DataFrame:
    """Pages of the groups whose main page has all the tags (None or empty: no filter), ``limit`` groups at most."""
    main = pages.where(F.col("is_main")).where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), tag_column)) == 0) if tags else pages.where("is_main")
    ids = main.select("group").distinct()
    return pages.join(ids.orderBy("group").limit(limit) if limit is not None else ids, "group", "left_semi")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One file that holds a JSON array of the rows: an export, for results that fit in one task. Rows are written as they come; nulls are kept."""
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    one = df.select(row.alias("r")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def append_text(df: DataFrame, column: str, path: str) -> None:
    """Adds the texts to those at ``path``, line by line."""
    df.select(F.col(column).alias("value")).write.mode("append").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def schema_file(spark: SparkSession, path: str) -> DataFrame:
    """One row (types, roles, type_roles) of a file of three JSON lines; empty parts are dropped. Without a file the schema is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([([], [], {})], "types array<string>, roles array<string>, type_roles map<string,array<string>>")
    t = spark.read.text(path, wholetext=True)
    p = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return t.select(F.from_json(F.get(p, F.lit(0)), "array<string>").alias("types"), F.from_json(F.get(p, F.lit(1)), "array<string>").alias("roles"), F.from_json(F.get(p, F.lit(2)), "map<string,array<string>>").alias("type_roles"))


def vocabulary(spark: SparkSession, entries: dict[str, dict[str, str]]) -> DataFrame:
    """(category, key, display) of a nested literal."""
    return spark.createDataFrame([(c, k, d) for c, v in entries.items() for k, d in v.items()], "category string, key string, display string")


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """(category, key, display) of a JSON file {category: {key: display}}; empty without a file. Of a key that a category repeats the last holds."""
    kind = "map<string,map<string,string>>"
    if not exists(spark, path):
        return spark.createDataFrame([], "category string, key string, display string")
    v = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("category", "v"))
    return v.select("category", F.explode("v").alias("key", "display"))


def topic_file(spark: SparkSession, path: str) -> DataFrame:
    """(topic, relations) of a JSON file {topic: [relation, ...]}, relations once each in their order; empty without a file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "topic string, relations array<string>")
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("topic", "r"))
    return t.select("topic", F.array_distinct(F.coalesce("r", F.array().cast("array<string>"))).alias("relations"))


def write_graph(nodes: dict[str, DataFrame], edges: DataFrame, path: str, keys: dict[str, str] | None = None) -> None:
    """A folder a label and one of the edges by relation, in place of what was there. Labels with a key in ``keys`` are dealt and sorted by it."""
    for label, df in nodes.items():
        key = (keys or {}).get(label)
        (indexed(df, key) if key else df).write.mode("overwrite").parquet(f"{path}/nodes_{label}")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, labels: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(nodes by label, edges) that ``write_graph`` has written."""
    return {l: spark.read.parquet(f"{path}/nodes_{l}") for l in labels}, spark.read.parquet(f"{path}/edges")


def delete_graph(spark: SparkSession, path: str) -> None:
    """Removes a stored graph, nodes and edges; one that isn't there is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Readers by the ending of a data set's files.
FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet", "txt": "text"}


def dataset(spark: SparkSession, path: str, schema: str | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    """A data set's rows, by the ending of ``path`` (or, of a folder, ``parquet``), columns of ``renames`` under their new names. A renamed column takes the place of one that bears its new name."""
    kind = FORMATS.get(path.rsplit(".", 1)[-1].lower(), "parquet")
    r = spark.read if schema is None else spark.read.schema(schema)
    df = (r.option("header", True) if kind == "csv" else r).format(kind).load(path)
    taken = {new for old, new in (renames or {}).items() if old in df.columns and new != old}
    return df.select(*[F.col(f"`{c}`").alias((renames or {}).get(c, c)) for c in df.columns if c not in taken])


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built and written first where there is none or an empty one (in any file system of Spark's)."""
    if not exists(spark, path + "/_SUCCESS") or spark.read.parquet(path).isEmpty():
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
