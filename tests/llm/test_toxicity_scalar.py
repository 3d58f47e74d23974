"""Scores against a network that is written out number by number, a window at a time, from its parameters alone."""

import math
import random

from test_llm import DOCS, texts

from graphloom.llm import toxicity as T


def words(text):
    out = []
    for w in (text or "").encode().lower().split():
        w = w.strip(b".,;:!?\"'()[]{}<>|*#%&$@-_+=/\\~^`")
        while w:
            out.append(w[: T.PIECE])
            w = w[T.PIECE :]
    return out


def bucket(values, more, size):
    h = 0
    for v in values:
        h = (h * 1099511628211 + v + more) % 2**64
    return (h * 0x9E3779B97F4A7C15 % 2**64 >> 40) % size


def vector(p, word):
    marked = [1, *word, 2]
    grams = [0.0] * T.DIM
    for n in (3, 5):
        for i in range(len(marked) - n + 1):
            row = p["gram"][bucket(marked[i : i + n], n, T.GRAMS)]
            grams = [a + 0.5 * float(b) for a, b in zip(grams, row)]
    return [float(v) for v in p["word"][bucket(marked, 7, T.WORDS)]] + grams


def sig(x):
    return 1 / (1 + math.exp(-max(-30, min(30, x))))


def times(x, m):
    """A row by a matrix."""
    return [sum(a * float(m[i][j]) for i, a in enumerate(x)) for j in range(len(m[0]))]


def states(p, xs, k):
    h = T.HIDDEN
    s, out = [0.0] * h, []
    for x in xs if k == "f" else reversed(xs):
        i = [a + float(b) for a, b in zip(times(x, p[f"w{k}"]), p[f"c{k}"])]
        a = times(s, p[f"u{k}"])
        z, r = [sig(i[j] + a[j]) for j in range(h)], [sig(i[h + j] + a[h + j]) for j in range(h)]
        c = [math.tanh(i[2 * h + j] + r[j] * a[2 * h + j]) for j in range(h)]
        s = [z[j] * s[j] + (1 - z[j]) * c[j] for j in range(h)]
        out.append(s)
    return out if k == "f" else out[::-1]


def logit(p, own):
    """Of a window's words."""
    if not own:
        return float(p["bias"][0])
    xs = [vector(p, w) for w in own]
    both = [a + b for a, b in zip(states(p, xs, "f"), states(p, xs, "b"))]
    e = [sum(math.tanh(v) * float(u) for v, u in zip(times(x, p["att"]), p["vec"])) for x in both]
    w = [math.exp(v - max(e)) for v in e]
    pooled = [sum(a * x[j] for a, x in zip(w, both)) / sum(w) for j in range(2 * T.HIDDEN)]
    return sum(a * float(b) for a, b in zip(pooled, p["out"])) + float(p["bias"][0])


def score(p, text):
    own, half = words(text), T.WINDOW // 2
    starts = [0]
    while starts[-1] + T.WINDOW < len(own) + (T.WINDOW - 2 * half):  # until the last word is in a window
        starts.append(starts[-1] + half)
    return sig(max(logit(p, own[s : s + T.WINDOW]) for s in starts))


def test_scores(spark):
    r = random.Random(3)
    rows = [(i, t.replace(" ", " zork ", 2) if i % 2 else t, "en", "s", 0) for i, t in enumerate(texts(60, 7))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    d = spark.createDataFrame(rows, DOCS)
    net = T.fitted(d, labels)
    long = " ".join(r.choice(["zork", "abc.", "…éé", "x" * 60, "!!", "Word"]) for _ in range(3 * T.WINDOW))
    exact = " ".join(f"w{i}" for i in range(T.WINDOW))
    some = [*rows[:8], (100, None, "", "", 0), (101, " !? ", "", "", 0), (102, long, "", "", 0), (103, exact, "", "", 0), (104, exact + " zork", "", "", 0)]
    got = {x.doc_id: x.score for x in T.scored(spark.createDataFrame(some, DOCS), net).collect()}
    for i, t, *_ in some:
        assert abs(got[i] - score(net.p, t)) < 1e-4, i
    assert len({round(v, 3) for v in got.values()}) > 4
