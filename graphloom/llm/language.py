"""Language ID by Bayesian evidence fusion.

Of each document: log P(text | language) from a byte-trigram model, P(declared | language) for the
language that its markup declares, P(suffix | language) for its address, and
P(language | host), smoothed from host to domain to the whole corpus. The three tables
are grouped aggregates over all documents of what the text alone says; only the trigram
model is fitted on a bounded sample, drawn within each declared language (``SAMPLE_ROWS`` rows in all).

``identified`` takes the declared language from a column; ``identified_pages`` reads it from the markup of pages
(``<html lang>``), whose addresses have hosts, domains and suffixes. Rows without an address have a source in place of a host.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import missing_names, saved, small_batches, table

#: Rows that the trigram model is fitted on.
SAMPLE_ROWS = 2_000
BUCKETS = 1 << 16
#: Trigrams follow from one another: a text counts as so many independent ones at most.
MOST_TRIGRAMS = 200.0
#: Weight, in documents, of the level above in the smoothing of a host or domain.
PRIOR_WEIGHT = 10.0
#: Below this posterior a document is rejected.
LEAST = 0.5
#: Evidence tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the text's byte trigrams with a letter (or a byte above ASCII) in them, in lower case, white space as one space."""
    b = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8)
    if len(b) < 3:
        return np.empty(0, np.int64)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    some = letter[:-2] | letter[1:-1] | letter[2:]
    x = b.astype(np.uint32)
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:])[some]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


class Model:
    """log P(trigram | language), add-half smoothed, for the languages in order."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({l for _, l in rows})
        n = np.zeros((len(self.languages), BUCKETS))
        for text, l in rows:
            n[self.languages.index(l)] += np.bincount(trigrams((text or "").encode("utf-8", "surrogatepass")), minlength=BUCKETS)
        n += 0.5
        self.log_p = np.ascontiguousarray(np.log(n / n.sum(axis=1, keepdims=True)).T.astype(np.float32))

    def __call__(self, text: str | None) -> np.ndarray | None:
        """Tempered log likelihood by language; None for texts without letters."""
        t = trigrams((text or "").encode("utf-8", "surrogatepass"))
        if not len(t):
            return None
        total = np.zeros(len(self.languages))
        for i in range(0, len(t), 1 << 16):
            total += self.log_p[t[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return total * (min(MOST_TRIGRAMS, len(t)) / len(t))


def plain(declared: Column) -> Column:
    """The language of a tag such as ``en-GB``, in lower case; null if there is none. A language has two to eight letters, as the syntax of tags has it."""
    l = F.lower(F.trim(F.substring_index(declared, "-", 1)))
    return F.when(l.rlike("^[a-z]{2,8}$"), l)


def fitted(docs: DataFrame, text: str = "text", declared: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, languages: int | None = None) -> Model:
    """A model of all declared languages, by at most rows / languages (10 at least) rows of each, those of the least hashes. A language takes 256 KB of it.

    ``languages``, if given, keeps the most declared ones alone: documents of others then get one of these or none.
    """
    t, l = F.col(f"`{text}`"), plain(F.col(f"`{declared}`"))
    known = docs.select(F.xxhash64(F.lit("language"), F.col(f"`{key}`"), t).alias("h"), l.alias("l"), t.alias("t")).where("l is not null")
    counts = known.groupBy("l").count().orderBy(F.desc("count"), "l")
    counts = (counts if languages is None else counts.limit(languages)).collect()  # a row a language
    if not counts:
        return Model([])
    each = max(10, rows // len(counts))
    # a hash is at most this for about three times the rows wanted (all, if there are few)
    upto = {r["l"]: min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, (3 * each + 30) / r["count"]))) for r in counts}
    near = lambda bounds: F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("l")]
    # hashes alone first, then the texts of those that count
    drawn = known.where(F.col("h") <= near(upto)).groupBy("l").agg(F.sort_array(F.collect_set("h")).alias("h"))  # some 3 ``each`` a language
    last = {r["l"]: r["h"] for r in drawn.select("l", F.slice("h", 1, each)[F.least(F.size("h"), F.lit(each)) - 1].alias("h")).collect()}
    some = known.where(F.col("h") <= near(last)).distinct()
    return Model([(r["t"], r["l"]) for r in sorted(some.collect(), key=lambda r: (r["l"], r["h"], r["t"] or ""))])  # a bounded sample: a row a hash


def scored(docs: DataFrame, model: Model, name: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``name``, the log likelihoods (array of doubles, null without letters)."""
    small_batches(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in keep]
    (held,) = missing_names(docs, "l_text")
    schema = docs.select(*columns, F.lit(None).cast("array<double>").alias(name)).schema

    def run(batches):
        for b in batches:
            ll = [model(t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([None if x is None else x.tolist() for x in ll], pa.list_(pa.float64()))], names=[*b.schema.names[: len(keep)], name])

    return docs.select(*columns, F.col(f"`{text}`").alias(held)).mapInArrow(run, schema)


def host_of(address: Column) -> Column:
    return F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)", 1))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def rates(counts: Column, above: Column) -> Column:
    """Counts by language smoothed by the rates of the level above."""
    n = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    return F.zip_with(counts, above, lambda c, p: (c + p * PRIOR_WEIGHT) / (n + PRIOR_WEIGHT))


class Evidence:
    """Grouped aggregates of what the text says, over all documents: ``seen`` has ll, declared, host."""

    def __init__(self, seen: DataFrame, languages: list[str]):
        self.languages, k = languages, len(languages)
        soft = softmax(F.col("ll"))
        s = seen.where("ll is not null").select(soft.alias("p"), "declared", "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
        sums = lambda *by: s.groupBy(*by).agg(*[F.sum(F.element_at("p", i + 1)).alias(f"s{i}") for i in range(k)]).select(*by, F.array(*[F.col(f"s{i}") for i in range(k)]).alias("n"))
        total = sums(F.lit(1).alias("one")).first()
        self.total = [x + 1.0 for x in total["n"]] if total else [1.0] * k
        overall = F.array(*[F.lit(x / sum(self.total)) for x in self.total])
        domains = sums("domain").select(F.col("domain").alias("d_domain"), rates(F.col("n"), overall).alias("d_rates"))
        hosts = sums("host", "domain").join(domains, F.col("domain") == F.col("d_domain"))
        self.hosts = saved(hosts.select("host", F.transform(rates(F.col("n"), F.col("d_rates")), lambda x: F.log(x)).alias("host_log")), "language_hosts")
        # P(declared | language) and P(suffix | language): a language's documents, one part in PRIOR_WEIGHT spread over the kinds
        self.declared, self.suffixes = (saved(self._given(sums(c), c), f"language_{c}") for c in ("declared", "suffix"))
        self.overall = overall

    def _given(self, counts: DataFrame, by: str) -> DataFrame:
        of = F.array(*[F.lit(x + PRIOR_WEIGHT) for x in self.total])
        return counts.where(F.col(by).isNotNull()).select(by, F.zip_with("n", of, lambda n, t: F.log((n + 0.5) / t)).alias(f"{by}_log"))


def softmax(ll: Column) -> Column:
    top = F.array_max(ll)
    e = F.transform(ll, lambda x: F.exp(x - top))
    n = F.aggregate(e, F.lit(0.0), lambda a, c: a + c)
    return F.transform(e, lambda x: x / n)


def fused(rows: DataFrame, ev: Evidence, ll: str, declared: str, host: str) -> DataFrame:
    """Adds language, probability, text_language, kept; see ``identified``."""
    a, b, c, post, hl, dl, sl = missing_names(rows, "e_host", "e_declared", "e_suffix", "e_post", "e_hl", "e_dl", "e_sl")

    def joined(df, evidence, by, log, key, value, name):
        t = evidence.select(F.col(by).alias(key), F.col(log).alias(name))
        t = F.broadcast(t) if evidence.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else t
        return df.join(t, value == F.col(key), "left").drop(key)

    r = joined(rows, ev.hosts, "host", "host_log", a, F.col(host), hl)
    r = joined(r, ev.declared, "declared", "declared_log", b, F.col(declared), dl)
    r = joined(r, ev.suffixes, "suffix", "suffix_log", c, suffix_of(F.col(host)), sl)
    none = F.array(*[F.lit(0.0)] * len(ev.languages))
    prior = F.coalesce(F.col(hl), F.transform(ev.overall, lambda x: F.log(x)))
    total = F.zip_with(F.zip_with(F.col(ll), prior, lambda x, y: x + y), F.zip_with(F.coalesce(F.col(dl), none), F.coalesce(F.col(sl), none), lambda x, y: x + y), lambda x, y: x + y)
    r = r.withColumn(post, softmax(total)).drop(hl, dl, sl)
    names = F.array(*[F.lit(x) for x in ev.languages]) if ev.languages else F.array().cast("array<string>")
    best = lambda x: F.get(names, F.array_position(x, F.array_max(x)).cast("int") - 1)
    r = r.withColumn("probability", F.coalesce(F.array_max(post), F.lit(0.0))).withColumn("language", F.coalesce(F.when(F.col("probability") >= LEAST, best(F.col(post))), F.lit("und")))
    return r.withColumn("text_language", F.coalesce(best(F.col(ll)), F.lit("und"))).withColumn("kept", F.col("language") != "und").drop(post)


def identified(docs: DataFrame, keep: list[str], text: str = "text", declared: str = "lang", host: str = "source", key: str = "doc_id", address: str | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with language ("und" if none reaches ``LEAST``), probability, text_language and kept.

    ``address`` names a column of URLs, whose hosts then stand for ``host``; hosts have a domain and a suffix where they
    have dots. Nulls in declared or host are no evidence; null or letterless texts are "und", probability 0, and not kept; equal probabilities
    go to the first language by name; without any declared language everything is "und". Rows stay as they are, repeated
    ones too. Of columns that bear the added names, the added ones stay. Empty input, empty result. Columns ``keep`` are written once with the likelihoods.
    """
    keep = [c for c in keep if c.lower() not in ("language", "probability", "text_language", "kept")]
    model = fitted(docs, text, declared, key)
    ll, d, h = missing_names(docs, "ll", "declared", "host")
    if not model.languages:
        return docs.select(*[F.col(f"`{x}`") for x in keep], F.lit(0.0).alias("probability"), F.lit("und").alias("language"), F.lit("und").alias("text_language"), F.lit(False).alias("kept"))
    where = host_of(F.col(f"`{address}`")) if address else F.lower(F.col(f"`{host}`"))
    docs = docs.withColumn(d, plain(F.col(f"`{declared}`"))).withColumn(h, where)
    rows = saved(scored(docs, model, ll, [*keep, d, h], text), "language_scores")  # each text is scored once
    ev = Evidence(rows.select(F.col(ll).alias("ll"), F.col(d).alias("declared"), F.col(h).alias("host")), model.languages)
    return fused(rows, ev, ll, d, h).drop(ll, d, h)


def identified_pages(pages: DataFrame) -> DataFrame:
    """page_id, declared, host, language, probability, text_language and kept of ``pages`` (page_id, url, html).

    The declared language is that of the first ``<html ... lang=...>``, quoted or bare; the text is the html without scripts, styles, comments and tags.
    Null html is an empty text, a null url no evidence. Other columns are ignored; empty input, empty result.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    lang = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{1,8})", 1)
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    rows = pages.select("page_id", "url", plain(lang).alias("declared"), host_of(F.col("url")).alias("host"), body.alias("body"))
    out = identified(rows, ["page_id", "declared", "host"], text="body", declared="declared", key="page_id", address="url")
    return out.select("page_id", "declared", "host", "language", "probability", "text_language", "kept")


def op9_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, ["doc_id"]).select("doc_id", "language", "probability", "text_language", "kept")


def op9_language_fusion_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified_pages(table(spark, sf_dir, "pages"))
