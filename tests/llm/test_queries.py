"""The registered queries themselves: on small tables with clashing columns, against their SQL where they have one."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import forest, registry

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
CLASHES = ("size", "target", "fp", "fp_text", "n_lines", "kept", "language", "ll", "m_rank", "r_no", "l_text", "n", "form", "fim", "did", "dh", "tree", "key", "rank", "data", "leaf", "shard", "row", "score", "piece", "offset", "record_type", "payload", "speaker", "dialogue")


def rows(seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(120)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    t = [text(r.randint(1, 60)) + "\n" + text(14) for _ in range(50)]
    t += [t[3], t[3] + " MORE", "", None, "  ", "Solo", t[7].upper(), "<P> mark " + t[8]]
    docs = [(i, x, r.choice(["en", "fi", None]), None if i % 9 == 0 else f"s{i % 4}", None if x is None else len(x)) for i, x in enumerate(t)]
    docs += [docs[2], (1 << 40, t[5], None, "s9", 1)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(40)]
    long = "<p>" + "long page " * 30
    pages = [(i, f"http://h{i % 3}.fi/{i}", r.choice([long, "short", f"<html lang='fi'><p>{text(20)}</p>", None])) for i in range(30)]
    turns = [(c, k, role, r.choice([text(4), None, ""])) for c in range(8) for k, role in enumerate(r.sample(["system", "user", "assistant", "ann"], r.randint(1, 4)))]
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)], 0) for i in range(80)] + [(90, None, 1), (100, [0.0] * 8, 1)]
    return dict(zip(TABLES, (docs, labels, pages, turns, vectors)))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for (name, schema), own in zip(TABLES.items(), rows().values()):
        df = spark.createDataFrame(own, schema)
        for c in CLASHES:
            df = df if c in df.columns else df.withColumn(c, F.lit("x"))
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def no_rows(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("no_rows")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, tables, no_rows, name):
    out = registry.QUERIES[name](spark, tables)
    got = [tuple(r[c] for c in sorted(out.columns)) for r in out.collect()]
    assert got
    assert registry.QUERIES[name](spark, no_rows).count() == 0
    own = rows()["documents"]
    if name.startswith(("op1_", "op2_", "op3_", "op6_", "op9_language_fusion", "op10_", "op11_", "op12_", "op13_")) and not name.endswith("pages"):
        at = sorted(out.columns).index("doc_id")
        assert Counter(x[at] for x in got) == Counter(d[0] for d in own)
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
        r = con.execute(registry.ORACLES[name])
        cols = [c[0] for c in r.description]
        assert sorted(cols) == sorted(out.columns)
        want = [tuple(x[cols.index(c)] for c in sorted(cols)) for x in r.fetchall()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_forest_on_vectors_that_cluster(spark):
    """Where vectors cluster, a small share of the rows is enough; over several shards."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(60, 32))
    v = centres[r.integers(0, 60, 3000)] + r.normal(scale=0.15, size=(3000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for x in forest.nearest(df, shard_rows=800, share=0.08).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hit = 0
    for q in range(0, 3000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (20 * 150) >= 0.9
