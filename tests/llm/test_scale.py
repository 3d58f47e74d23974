"""Inputs that break what is sized for common ones: very many lines in a text, families of a template, many languages, stages whose results wait."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import common, language, shingles
from graphloom.llm.line_dedup import dedup_lines, member_filter
from graphloom.llm.near_copies import kept_of_near

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_text_of_over_a_million_lines(spark):
    text = "\n".join("some words of a line that is here twice and more" if i in (5, 1_150_000) else "" for i in range(1_200_000))
    d = spark.createDataFrame([(1, text), (2, "one two three four five six seven")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in dedup_lines(d).select("doc_id", "n_lines", "n_removed").collect()}
    assert got == {1: (1_200_000, 1), 2: (1, 0)}


def test_sorted_sets_of_many_units():
    import numpy as np

    r = np.random.default_rng(0)
    unit = np.sort(np.concatenate([r.integers(0, 1 << 21, 3000), [1 << 21]]))
    tokens = r.integers(0, 50, len(unit)).astype(np.uint64) << np.uint64(40)
    t, u = shingles.sorted_sets(tokens, unit)
    assert sorted({(int(b), int(a)) for a, b in zip(tokens, unit)}) == list(zip(u.tolist(), t.tolist()))


def family(n):
    base = [f"w{i}" for i in range(47)]
    return [(i, " ".join(base[:20] + [f"a{i}", f"b{i}"] + base[20:])) for i in range(n)]


@pytest.mark.parametrize("run", [dedup_lines, kept_of_near])
def test_a_family_of_a_template(spark, run):
    """Variants that share most tokens but aren't similar enough: their number doesn't square."""
    took = []
    for n in (1500, 6000):
        d = spark.createDataFrame(family(n), "doc_id long, text string")
        began = time.time()
        assert run(d).count() == n
        took.append(time.time() - began)
    assert took[1] < 2 * took[0] + 5


def test_languages_beyond_two_hundred(spark):
    r = random.Random(3)
    tags = [a + b for a in "abcdefghijklmno" for b in "abcdefghijklmnop"]
    words = {t: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for t in tags}
    rows = [(i * 12 + k, " ".join(r.choice(words[t]) for _ in range(30)), t, None, 9) for i, t in enumerate(tags) for k in range(12)]
    d = spark.createDataFrame(rows, DOCS)
    assert len(language.fitted(d).languages) == len(tags) == 240
    assert len(language.fitted(d, languages=7).languages) == 7
    assert language.fitted(d.withColumn("lang", F.lit("not a tag"))).languages == []


def documents(n, seed):
    r = random.Random(seed)
    vocabulary = {l: ["".join(r.choice(c) for _ in range(r.randint(3, 8))) for _ in range(80)] for l, c in (("en", "aeioubcdfg"), ("fi", "äöyhklmnst"))}
    out = []
    for i in range(n):
        l = r.choice(["en", "fi"])
        out.append((i, "\n".join(" ".join(r.choice(vocabulary[l]) for _ in range(r.randint(6, 14))) for _ in range(r.randint(2, 6))), l, f"s{i % 3}", 5))
    return out


def test_two_stages_before_either_is_used(spark):
    a, b = (spark.createDataFrame(documents(60, s), DOCS) for s in (1, 2))
    x, y = corpus_pipeline.language_id(spark, a, ""), corpus_pipeline.language_id(spark, b, "")
    assert y.count() > 40 and x.count() > 40
    x, y = corpus_pipeline.line_dedup(spark, a, ""), corpus_pipeline.line_dedup(spark, b, "")
    assert y.count() == 60 == x.count()


def test_two_pipelines_and_what_they_leave(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path / "shared"))
    for s in (1, 2):
        spark.createDataFrame(documents(80, s), DOCS).write.parquet(f"{tmp_path}/{s}/documents.parquet")
    one, two = (corpus_pipeline.run(spark, f"{tmp_path}/{s}") for s in (1, 2))
    assert two.count() > 0 and one.count() > 0
    left = [n for n in os.listdir(tmp_path / "shared") if not n.startswith(".") and os.path.isdir(tmp_path / "shared" / n)]
    # what the two lazy results still read: the mix, and the tables of its last stage; all else is gone
    assert {n.rsplit("_", 1)[0] for n in left if "-" not in n} <= {"pipeline_source_mixing"}
    held = common.Scratch(spark)
    with held:
        out = common.saved(spark.range(5), "kept")
    assert out.count() == 5 and len(held.paths) == 1
    held.close()
    assert not any("kept" in n for n in os.listdir(tmp_path / "shared"))


def test_a_member_filter_takes_no_job_a_partition(spark):
    """All members pass, few others do, and the driver runs as few jobs with many partitions as with few."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("member_filter", "")
    try:
        rows = spark.range(0, 30_000, 10).select(F.col("id").alias("did"), (F.col("id") % 7).alias("dh"))
        test = member_filter(rows, "did", "dh")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("member_filter")
        passed = {r.did for r in spark.range(30_000).select(F.col("id").alias("did"), (F.col("id") % 7).alias("dh")).where(test).collect()}
        assert spark.range(9).select(F.col("id").alias("did"), F.col("id").alias("dh")).where(member_filter(rows.limit(0), "did", "dh")).count() == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert set(range(0, 30_000, 10)) <= passed and len(passed) < 6_000
    assert len(jobs) < 10
