"""Pages end to end: read a tree of HTML, parse, save, and reload by tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.html import parsed
from graphloom.sources.files import groups_with, html_tree


def page_table(files: DataFrame, excluded: frozenset[str] = frozenset()) -> DataFrame:
    """(group, path, is_main, tag, links, blocks, text) of ``files`` (group, path, html).

    A group's main page is the one of its name, else the first by path; null html is a page without anything.
    """
    p = files.select("group", "path", parsed(F.col("html"), excluded=excluded).alias("p"))
    named = F.endswith("path", F.concat(F.col("group"), F.lit(".html")))
    first = files.groupBy(F.col("group").alias("m_group")).agg(F.min(F.struct((~named).alias("other"), "path"))["path"].alias("m_path"))
    j = p.join(first, F.col("group") == F.col("m_group"))
    return j.select("group", "path", (F.col("path") == F.col("m_path")).alias("is_main"), F.col("p.tags").alias("tag"), "p.links", "p.blocks", "p.text")


def saved_pages(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The pages of all .html files under ``folder``, written as a table at ``path`` and read again."""
    page_table(html_tree(spark, folder)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pages_of(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """The saved pages of the groups whose main page has the tag (all without one)."""
    return groups_with(spark.read.parquet(path), [tag] if tag else None)
