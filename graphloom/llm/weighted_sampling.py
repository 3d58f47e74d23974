"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its shingles of five words (ASCII letters in lower case, cut at
ASCII white space; a text of fewer words is one term) with their counts as weights.
For each of ``SAMPLES`` samples a term of weight S draws r, c ~ Gamma(2, 1) and
b ~ U(0, 1), all fixed by (term, sample), and

    t = floor(ln S / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r;

the term with the least ln a gives the sample (term, t). Two texts agree in a sample
with the probability of their generalised Jaccard similarity, sum of least over sum of greatest weights.
The draws come from a pool of 2^16 triples, chosen by a multiply-shift hash of the
term for each sample; terms that meet in the least triple are told apart by their own hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import mix64, small_batches, table

SHINGLE = 5
SAMPLES = 128
POOL_BITS = 16
#: Rows of one sorted range, about.
RANGE_ROWS = 4_000
MOST_RANGES = 100_000
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Sampler:
    def __init__(self, samples: int = SAMPLES, shingle: int = SHINGLE, seed: int = 42):
        rng = np.random.default_rng(seed)
        n = 1 << POOL_BITS
        self.samples, self.shingle = samples, shingle
        self.r = rng.gamma(2.0, 1.0, n)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n))
        self.b = rng.random(n)
        # ln a of weight 1, where ln S = 0 and so t = 0
        self.unit = (self.log_c + self.r * self.b - self.r).astype(np.float32)
        self.odd = rng.integers(0, 1 << 64, samples, dtype=np.uint64) | np.uint64(1)
        self.column = np.arange(samples)
        self.power = np.ones(1, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def _powers(self, n: int) -> np.ndarray:
        while len(self.power) < n:
            more = self.power * (BASE ** np.uint64(len(self.power)))
            self.power = np.concatenate([self.power, more])
        return self.power[:n]

    def terms(self, text: bytes) -> np.ndarray:
        """A hash of each shingle, in order, repeats included."""
        raw = np.frombuffer(text, np.uint8)
        if not len(raw):
            return np.empty(0, np.uint64)
        word = ~self.space[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        n = len(starts)
        if not n:
            return np.empty(0, np.uint64)
        value = self.lower[raw].astype(np.uint64) + np.uint64(1)
        out = np.zeros(n, np.uint64)
        length = ends - starts
        # polynomial hash of each word, letter by letter over all words at once; rare long ones apart
        most = min(int(length.max()), 48)
        live = np.arange(n)
        for i in range(most):
            live = live[length[live] > i]
            out[live] = out[live] * BASE + value[starts[live] + i]
        for j in np.flatnonzero(length > most).tolist():
            out[j] = np.uint64(int.from_bytes(hashlib.blake2b(value[starts[j] : ends[j]].astype(np.uint8).tobytes(), digest_size=8).digest(), "little"))
        out = mix64(out)
        k = min(self.shingle, n)
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h = h * BASE + out[i : n - k + 1 + i]
            h ^= h >> np.uint64(29)
        return mix64(h + np.uint64(k))

    def sample(self, terms: np.ndarray) -> np.ndarray:
        """``samples`` values of 16 bits; those of no terms are all 0xFFFF."""
        if not len(terms):
            return np.full(self.samples, 0xFFFF, np.uint16)
        h, weight = np.unique(terms, return_counts=True)  # ascending: the first of equal values has the least hash
        best, term, step = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int64)
        shift = np.uint64(64 - POOL_BITS)
        for i in range(0, len(h), 1024):
            part, w = h[i : i + 1024], weight[i : i + 1024]
            at = ((part[:, None] * self.odd[None, :]) >> shift).astype(np.int32)
            value = self.unit[at]
            heavy = np.flatnonzero(w > 1)
            if len(heavy):
                a = at[heavy]
                r, b = self.r[a], self.b[a]
                t = np.floor(np.log(w[heavy].astype(np.float64))[:, None] / r + b)
                value[heavy] = (self.log_c[a] - r * (t - b) - r).astype(np.float32)
            least = value.argmin(axis=0)
            low = value[least, self.column]
            won = np.flatnonzero(low < best)
            best[won], term[won], step[won] = low[won], part[least[won]], 0
            if len(heavy):
                place = np.full(len(part), -1)
                place[heavy] = np.arange(len(heavy))
                own = place[least[won]]
                some = own >= 0
                step[won[some]] = t[own[some], won[some]].astype(np.int64)
        code = mix64(term + step.astype(np.uint64) * BASE)
        return (code >> np.uint64(48)).astype(np.uint16) & np.uint16(0xFFFE)  # 0xFFFF is left to texts without terms

    def __call__(self, text: str) -> np.ndarray:
        return self.sample(self.terms(text.encode("utf-8", "surrogatepass")))


def encoded(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimate of generalised Jaccard similarity: the share of equal samples."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 3) code points replaced by the first as many (or all) of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_pairs(docs: DataFrame, samples: int = SAMPLES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints each text of ``docs`` (doc_id, text), its edited text, and compares it with these and the next text.

    The next document is the one with the next smaller doc_id; after the last the first. Null
    texts are empty, null doc_ids come last, rows with one doc_id go by their text, descending;
    a single row is its own next. Empty input, empty result; other columns are ignored.

    Ranges of doc_id hold about ``range_rows`` rows each, by quantiles (at most
    ``MOST_RANGES`` bounds reach the driver). The rows with the greatest doc_id of a range are also dealt to the range before
    it, so that every range has the text after its last and is fingerprinted in one sorted pass.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("place", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)))
    ids = d.select("place")
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, n // range_rows))
    bounds: list[int] = []
    if ranges > 1:
        found = ids.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], F.lit(20 * ranges).cast("int"))).first()[0]
        bounds = sorted(set(found))
    # a row belongs to the range of the first bound at or above its place
    bounded = F.lit(0) if not bounds else None
    if bounds:
        first = spark.createDataFrame([(i, b) for i, b in enumerate(bounds)], "i int, upto long")
        listed = F.broadcast(first.agg(F.array_sort(F.collect_list("upto")).alias("bounds")))
        d = d.crossJoin(listed)
        # binary search in the sorted array, unrolled: ceil(log2(bounds + 1)) steps
        low, high = F.lit(0), F.lit(len(bounds))
        d = d.withColumn("lo", low).withColumn("hi", high)
        for _ in range(len(bounds).bit_length()):
            mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
            right = (F.col("lo") < F.col("hi")) & (F.get("bounds", mid) < F.col("place"))
            d = d.withColumns({"lo": F.when(right, mid + 1).otherwise(F.col("lo")), "hi": F.when(right | (F.col("lo") >= F.col("hi")), F.col("hi")).otherwise(mid)})
        d = d.withColumnRenamed("lo", "range").drop("hi", "bounds")
    else:
        d = d.withColumn("range", bounded)
    heads = {r["range"]: r["head"] for r in d.groupBy("range").agg(F.min("place").alias("head")).collect()}  # a row a range
    order = sorted(heads)
    previous = {heads[k]: order[i - 1] for i, k in enumerate(order)}  # the first range's head goes to the last
    extra = F.lit(None).cast("int")
    if order:
        pairs = spark.createDataFrame([(h, p) for h, p in previous.items()], "head long, before int")
        d = d.join(F.broadcast(pairs), F.col("place") == F.col("head"), "left")  # at most MOST_RANGES rows
        extra = F.col("before")
    dealt = d.select("doc_id", "text", "place", F.explode(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead")), F.struct(extra.alias("range"), F.lit(True).alias("ahead")))).alias("to"))
    dealt = dealt.where("to.range is not null").select(F.col("to.range").alias("range"), F.col("to.ahead").alias("ahead"), "doc_id", "place", "text")
    parts = max(1, min(len(order), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "ahead", "place", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(batches):
        draw = Sampler(samples)
        held = None  # (range, doc_id, text, signature) of the row whose next one is awaited

        def row(a, text, signature):
            changed = edited(a[2], text)
            own = draw(changed)
            return (a[1], len(a[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), encoded(a[3]), encoded(own), likeness(a[3], own), likeness(a[3], signature))

        for b in batches:
            out = []
            for rng, ahead, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if ahead and (held is None or held[0] != rng):
                    continue  # only the first row ahead counts
                text = text.as_py()
                signature = draw(text)
                if held is not None and held[0] == rng:
                    out.append(row(held, text, signature))
                held = None if ahead else (rng, doc, text, signature)
            if out:
                cols = list(zip(*out))
                types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return dealt.select("range", "ahead", "doc_id", "text").mapInArrow(run, SCHEMA)


def op1_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
