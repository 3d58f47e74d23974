"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut at white space into words, and into all windows of ``WINDOW`` words that
overlap by half. A word enters as an embedding of its hash and the sum of embeddings of its
hashed character n-grams. Labels are of documents, so that a document's score is that
of its most toxic window, and training takes each document's top window as the network sees it in turn.

The network is fitted on the driver, on at most ``MOST_TOXIC`` toxic and ``MOST_CLEAN`` other labelled
rows that are not held out, the first by a hash of doc_id; every row is scored on the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, table

MOST_TOXIC = 700
MOST_CLEAN = 1400
WINDOW = 48
WORDS = 1 << 14
GRAMS = 1 << 14
DIM = 8
HIDDEN = 12
EPOCHS = 6
BATCH = 64
#: Longer words are cut into pieces of so many bytes, each a word.
PIECE = 24
#: Words whose inputs a worker keeps.
KEPT = 400_000


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def words_of(text: str | None) -> list[bytes]:
    """Words in ASCII lower case without signs at their ends; signs alone are no words."""
    out = []
    for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
        w = w.strip(b".,;:!?\"'()[]{}<>|*#%&$@-_+=/\\~^`")
        if len(w) <= PIECE:
            if w:
                out.append(w)
        else:
            out.extend(w[i : i + PIECE] for i in range(0, len(w), PIECE))
    return out


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets (n,) and n-gram buckets (n, m), the latter -1 where there is none: the trigrams and 5-grams of ^word$."""
    width = max(map(len, words)) + 2
    b = np.zeros((len(words), width), np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    raw = np.array(words, dtype=f"S{width - 2}").view(np.uint8).reshape(len(words), width - 2)
    b[:, 1:-1] = raw
    b[:, 0] = 1
    b[np.arange(len(words)), size - 1] = 2
    whole = np.zeros(len(words), np.uint64)
    for i in range(width):
        whole = np.where(i < size, whole * np.uint64(1099511628211) + b[:, i] + np.uint64(7), whole)
    grams = []
    for n in (3, 5):
        if width < n:
            continue
        h = np.zeros((len(words), width - n + 1), np.uint64)
        for i in range(n):
            h = h * np.uint64(1099511628211) + b[:, i : width - n + 1 + i] + np.uint64(n)
        g = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % GRAMS
        grams.append(np.where(np.arange(width - n + 1)[None, :] + n <= size[:, None], g, -1))
    word = ((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % WORDS
    return word, np.concatenate(grams, axis=1) if grams else np.full((len(words), 1), -1)


def hashed_all(words: list[bytes], at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """``hashed`` part by part, with narrow n-gram buckets."""
    parts = [hashed(words[i : i + at_once]) for i in range(0, len(words), at_once)]
    most = max(g.shape[1] for _, g in parts)
    grams = np.full((len(words), most), -1, np.int16)
    for k, (_, g) in enumerate(parts):
        grams[k * at_once : k * at_once + len(g), : g.shape[1]] = g
    return np.concatenate([w for w, _ in parts]), grams


class Network:
    """Parameters and passes. Windows are (batch, time) indexes into a table of word inputs; 0 is no word."""

    def __init__(self, seed: int = 42):
        rng = np.random.default_rng(seed)
        d, h = 2 * DIM, HIDDEN
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": 0.05 * init(WORDS, DIM) * np.sqrt(WORDS), "gram": 0.05 * init(GRAMS, DIM) * np.sqrt(GRAMS), "att": init(2 * h, 8), "vec": init(8, 1)[:, 0], "out": init(2 * h, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"w{k}": init(d, 3 * h), f"u{k}": init(h, 3 * h), f"c{k}": np.zeros(3 * h, np.float32)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, word: np.ndarray, grams: np.ndarray) -> np.ndarray:
        g = self.p["gram"][grams] * (grams >= 0)[:, :, None]
        return np.concatenate([self.p["word"][word], 0.5 * g.sum(axis=1)], axis=1)

    def inputs_all(self, word: np.ndarray, grams: np.ndarray, at_once: int = 8192) -> np.ndarray:
        return np.concatenate([np.zeros((1, 2 * DIM), np.float32), *(self.inputs(word[i : i + at_once], grams[i : i + at_once]) for i in range(0, len(word), at_once))])

    def scores(self, x: np.ndarray, at: np.ndarray, at_once: int = 1024) -> np.ndarray:
        """Logits of windows over a large table, of which each part takes its own rows."""
        out = []
        for i in range(0, len(at), at_once):
            own, inner = np.unique(at[i : i + at_once], return_inverse=True)
            if own[0] != 0:
                own, inner = np.concatenate(([0], own)), inner + 1
            out.append(self.forward(x[own], inner.reshape(-1, at.shape[1])))
        return np.concatenate(out)

    def _gru(self, xp: np.ndarray, mask: np.ndarray, k: str, keep: bool):
        """States for each time; ``xp`` (batch, time, 3 h) are the projected inputs."""
        h, u = HIDDEN, self.p[f"u{k}"]
        n, t, _ = xp.shape
        s, states, kept = np.zeros((n, h), np.float32), np.zeros((n, t, h), np.float32), [None] * t
        for i in range(t) if k == "f" else range(t - 1, -1, -1):
            a = s @ u
            zr = sigmoid(xp[:, i, : 2 * h] + a[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(xp[:, i, 2 * h :] + r * a[:, 2 * h :])
            m = mask[:, i : i + 1]
            new = s + m * (1 - z) * (c - s)
            if keep:
                kept[i] = (s, z, r, c, a[:, 2 * h :], m)
            s = new
            states[:, i] = s
        return states, kept

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows ``at`` over the word inputs ``x`` (row 0: no word)."""
        mask = (at > 0).astype(np.float32)
        proj = {k: (x @ self.p[f"w{k}"] + self.p[f"c{k}"])[at] for k in "fb"}
        hf, kf = self._gru(proj["f"], mask, "f", keep)
        hb, kb = self._gru(proj["b"], mask, "b", keep)
        hs = np.concatenate([hf, hb], axis=2)
        e = np.tanh(hs @ self.p["att"])
        score = e @ self.p["vec"] + (mask - 1) * 1e4
        w = np.exp(score - score.max(axis=1, keepdims=True)) * mask
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
        pooled = (w[:, :, None] * hs).sum(axis=1)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (mask, hs, e, w, pooled, kf, kb)) if keep else logit

    def backward(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean log loss, and of the word inputs."""
        p, h = self.p, HIDDEN
        logit, (mask, hs, e, w, pooled, kf, kb) = self.forward(x, at, True)
        dl = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * p["out"][None, :]
        dhs = w[:, :, None] * dp[:, None, :]
        dw = (hs * dp[:, None, :]).sum(axis=2)
        ds = w * (dw - (w * dw).sum(axis=1, keepdims=True))
        g["vec"] = np.einsum("nt,ntk->k", ds, e)
        de = ds[:, :, None] * p["vec"] * (1 - e * e)
        g["att"] = np.einsum("nth,ntk->hk", hs, de)
        dhs = dhs + de @ p["att"].T
        dx = np.zeros_like(x)
        for k, kept, part in (("f", kf, dhs[:, :, :h]), ("b", kb, dhs[:, :, h:])):
            u, t = p[f"u{k}"], at.shape[1]
            dproj = np.zeros((*at.shape, 3 * h), np.float32)
            du, back = np.zeros_like(u), np.zeros((len(at), h), np.float32)
            for i in range(t - 1, -1, -1) if k == "f" else range(t):
                s, z, r, c, ac, m = kept[i]
                d = part[:, i] + back
                dc = d * m * (1 - z) * (1 - c * c)
                dz = d * m * (s - c) * z * (1 - z)
                dr = dc * ac * r * (1 - r)
                da = np.concatenate([dz, dr, dc * r], axis=1)
                du += s.T @ da
                back = d * (1 - m * (1 - z)) + da @ u.T
                dproj[:, i] = np.concatenate([dz, dr, dc], axis=1)
            flat, idx = dproj.reshape(-1, 3 * h), at.ravel()
            into = np.zeros((len(x), 3 * h), np.float32)
            np.add.at(into, idx, flat)
            into[0] = 0
            g[f"w{k}"], g[f"u{k}"], g[f"c{k}"] = x.T @ into, du, into.sum(axis=0)
            dx += into @ p[f"w{k}"].T
        return g, dx


def windows(n: int, size: int = WINDOW) -> np.ndarray:
    """Starts of the overlapping windows that cover n words."""
    return np.arange(0, max(1, n - size // 2), size // 2)


def framed(ids: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """All windows of a text's word indexes, padded with 0."""
    starts = windows(len(ids), size)
    padded = np.zeros(starts[-1] + size, np.int32)
    padded[: len(ids)] = ids
    return padded[starts[:, None] + np.arange(size)[None, :]]


def trained(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 42) -> Network | None:
    """A network fitted to documents and their labels; None without both labels."""
    docs = [(words_of(t), y) for t, y in zip(texts, labels)]
    docs = [(w, y) for w, y in docs if w]
    if len({y for _, y in docs}) < 2:
        return None
    rng, net = np.random.default_rng(seed), Network(seed)
    place: dict[bytes, int] = {}
    ids = [np.fromiter((place.setdefault(w, len(place) + 1) for w in ws), np.int32, len(ws)) for ws, _ in docs]
    y = np.array([k for _, k in docs], np.float32)
    word, grams = hashed_all(list(place))
    frames = [framed(i) for i in ids]
    # the first dimension of each embedding starts as the log odds of its bucket in toxic documents
    p, present = net.p, [np.unique(i) - 1 for i in ids]
    for key, size, buckets in (("word", WORDS, lambda i: np.unique(word[i])), ("gram", GRAMS, lambda i: np.setdiff1d(grams[i], [-1]))):
        n = np.zeros((2, size))
        for i, k in zip(present, y):
            n[int(k)][buckets(i)] += 1
        odds = np.log((n[1] + 0.5) / (y.sum() + 1)) - np.log((n[0] + 0.5) / (len(y) - y.sum() + 1))
        p[key][:, 0] = np.clip(odds, -1, 4) * 0.5 * (n.sum(axis=0) > 0)
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    step, every = 0, np.concatenate(frames)
    owner = np.repeat(np.arange(len(frames)), [len(f) for f in frames])
    first = np.concatenate(([0], np.cumsum([len(f) for f in frames])[:-1]))
    for epoch in range(epochs):
        x = net.inputs_all(word, grams)
        if epoch:
            s = net.scores(x, every)
        else:  # as yet the window of the most telling word
            telling = x[:, 0] + x[:, DIM]
            s = np.concatenate([telling[every[i : i + 2048]].max(axis=1) for i in range(0, len(every), 2048)])
        order = np.lexsort((-s, owner))
        top = order[first]  # each document's highest
        spare = first + (rng.random(len(first)) * np.bincount(owner)).astype(np.int64)
        use = np.concatenate([top, spare[y == 0]])
        rng.shuffle(use)
        for i in range(0, len(use), BATCH):
            at = every[use[i : i + BATCH]]
            own, inner = np.unique(at, return_inverse=True)
            if own[0] != 0:
                own, inner = np.concatenate(([0], own)), inner + 1
            inner = inner.reshape(at.shape)
            w, gr = word[own[1:] - 1], grams[own[1:] - 1].astype(np.int64)
            x = np.concatenate([np.zeros((1, 2 * DIM), np.float32), net.inputs(w, gr)])
            g, dx = net.backward(x, inner, y[owner[use[i : i + BATCH]]])
            g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
            np.add.at(g["word"], w, dx[1:, :DIM])
            r, c = np.nonzero(gr >= 0)
            np.add.at(g["gram"], gr[r, c], 0.5 * dx[1:][r, DIM:])
            step += 1
            rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in p:
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.001 * (g[k] * g[k] - square[k])
                p[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores texts in groups, keeping the projected inputs of words that it has seen."""

    def __init__(self, net: Network):
        self.net, self.place, self.x = net, {}, np.zeros((1, 2 * DIM), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        if len(self.place) > KEPT:
            self.place, self.x = {}, self.x[:1]
        place = self.place
        new = list({w for ws in docs for w in ws if w not in place})
        if new:
            rows = [self.net.inputs(*hashed(new[i : i + 8192])) for i in range(0, len(new), 8192)]
            place.update(zip(new, range(len(place) + 1, len(place) + 1 + len(new))))
            self.x = np.concatenate([self.x, *rows])
        out = np.empty(len(docs))
        group, owner, n = [], [], 0

        def flush():
            nonlocal group, owner, n
            if group:
                s = self.net.scores(self.x, np.concatenate(group))
                np.maximum.at(out, np.concatenate(owner), s)
            group, owner, n = [], [], 0

        out[:] = -np.inf
        for k, ws in enumerate(docs):
            ids = np.fromiter(map(place.__getitem__, ws), np.int32, len(ws))
            f = framed(ids)
            for i in range(0, len(f), 4096):
                part = f[i : i + 4096]
                group.append(part)
                owner.append(np.full(len(part), k))
                n += len(part)
                if n >= 4096:
                    flush()
        flush()
        return sigmoid(out)


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def fitted(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Network | None:
    """Trains on labelled rows that are not held out: at most ``most_toxic`` and ``most_clean`` doc_ids, those of the least hashes.

    A doc_id of several texts trains with that of the least hash; one of both labels with each.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("k"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.join(docs.select(F.col("doc_id").alias("k")).distinct(), "k", "left_semi").where(~held_out("k")).distinct()
    some = None
    for value, most in ((1, most_toxic), (0, most_clean)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("k"), "k").limit(most)
        some = part if some is None else some.unionByName(part)
    ids = [(r["k"], r["toxic"]) for r in some.collect()]  # most_toxic + most_clean rows at most
    if not ids:
        return None
    chosen = docs.sparkSession.createDataFrame(ids, "k long, toxic int")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).groupBy("k", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).collect()  # a row for each of ``ids``
    rows.sort(key=lambda r: (r["k"], r["toxic"]))
    return trained([r["t"]["text"] for r in rows], [r["toxic"] for r in rows])


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Null and empty texts and those without words are a window without words, scored by the network's bias; null doc_ids
    count as held out; equal texts have equal scores; without a network (no labels of both kinds) every score is 0. Other columns
    are ignored; empty input, empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        scorer = Scorer(net) if net is not None else None
        for b in batches:
            texts = b.column(2).to_pylist()
            s = scorer(texts) if scorer and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
