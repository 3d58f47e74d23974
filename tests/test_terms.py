"""Places of terms, words of texts without spaces and common subsequences against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import segment, terms
from graphloom.operators import evaluation as M


def texts(n, seed=0, alphabet="abé😀"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("held", [1 << 18, 7])
def test_term_offsets(spark, held):
    docs = [(i, t) for i, t in enumerate(texts(60))] + [(None, "ab"), (99, None)]
    wanted = sorted({t[:k] for t in texts(20, 1) for k in (1, 2, 3, 5)}) + ["a", "aa", "aba"]
    d = spark.createDataFrame(docs, "id long, t string").repartition(3)
    w = spark.createDataFrame([(x,) for x in [*wanted, "a", None]], "w string")
    got = sorted((r.id if r.id is not None else -1, r.term, r.offset) for r in terms.term_offsets(d, "id", "t", w, "w", held).collect())
    want = sorted((i if i is not None else -1, x, k) for i, t in docs if t is not None for x in set(wanted) for k in range(len(t) - len(x) + 1) if t[k : k + len(x)] == x)
    assert got == want
    assert terms.term_offsets(d, "id", "t", w.limit(0), "w").count() == 0 and terms.term_offsets(d.limit(0), "id", "t", w, "w").count() == 0


def test_offsets_of_one_term(spark):
    rows = [("ababa", "aba"), ("", "a"), ("abc", ""), ("😀a😀a", "a"), (None, "a"), ("a", None), ("", "")]
    d = spark.createDataFrame(rows, "t string, x string")
    assert [r[0] for r in d.select(terms.all_offsets(F.col("t"), F.col("x"))).collect()] == [[0, 2], [], [0, 1, 2, 3], [1, 3], None, None, [0]]


def every_cut(run):
    for bits in itertools.product((0, 1), repeat=max(len(run) - 1, 0)):
        out, start = [], 0
        for i, b in enumerate(bits, 1):
            if b:
                out.append(run[start:i])
                start = i
        yield [*out, run[start:]]


def test_the_likeliest_path():
    r = random.Random(3)
    for _ in range(60):
        counts = {"".join(r.choice("甲乙丙") for _ in range(r.randint(1, 3))): r.randint(1, 50) for _ in range(8)}
        held, total = segment.Words(counts), sum(counts.values())
        run = "".join(r.choice("甲乙丙丁") for _ in range(r.randint(2, 9)))
        score = lambda words: sum(math.log(counts.get(w, 1) / total) if w in counts or len(w) == 1 else -math.inf for w in words)  # noqa: B023, E731
        best = max(map(score, every_cut(run)))
        got = held(run)
        assert "".join(got) == run and abs(score(got) - best) < 1e-9


def test_words(spark):
    counts = {"北京": 9, "大学": 8, "北京大学": 20, "生": 3, "大学生": 5, "活": 1, "生活": 7, "": 4, "错": 0}
    d = spark.createDataFrame([("北京大学生活",), ("in 北京 2024, C++ v1.5!",), ("",), (None,), ("错",)], "t string")
    assert [r[0] for r in d.select(segment.words(F.col("t"), counts)).collect()] == [["北京大学", "生活"], ["in", "北京", "2024", ",", "C", "+", "+", "v1.5", "!"], [], None, ["错"]]
    t = spark.createDataFrame([("a", 3), ("b", 5), ("c", 5), (None, 9), ("d", 0)], "w string, n long")
    assert segment.table_of(t, "w", "n") == {"a": 3, "b": 5, "c": 5} and list(segment.table_of(t, "w", "n", 1)) == ["b"]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 90))] for _ in range(2))
        assert M.lcs(a, b) == longest(a, b)


def test_rouge(spark):
    d = spark.createDataFrame([("北京大学生活", "生活北京大学"), ("北京大学", None), ("", "")], "a string, b string")
    counts = {"北京大学": 20, "生活": 7}
    got = [tuple(r[0]) for r in d.select(M.rouge(F.col("a"), F.col("b"), counts)).collect()]
    assert got == [(100.0, 0.0, 50.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    d = spark.createDataFrame([("a b c d", "a c d")], "a string, b string")
    assert tuple(d.select(M.rouge(F.col("a"), F.col("b"))).first()[0]) == (85.7143, 40.0, 85.7143)


def test_errors_of_a_group(spark):
    c = spark.createDataFrame([("g", 1, 2, 3)], "k string, tp long, gold long, pred long")
    o = spark.createDataFrame([("g", True), ("g", False), ("h", None)], "k string, ok boolean")
    got = {r.k: (r.tp, r.gold, r.pred, r.errors) for r in M.totals(M.with_errors(c, o, ["k"]), ["k"]).collect()}
    assert got == {"g": (1, 2, 3, 1), "h": (0, 0, 0, 1), None: (1, 2, 3, 2)}
