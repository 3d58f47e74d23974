"""SimHash near-duplicates with bit-sliced comparison.

Equal fingerprints are one node. Fingerprints within ``RADIUS`` = 2 bits agree on at
least two of four 16-bit quarters, so that each node is dealt to six tables by
32 bits and only rows that share those are compared. A bucket of more than ``LARGE``
nodes is dealt again by thirds of its other 32 bits, one of which must agree
too; such a bucket holds at most 2^22 nodes, whatever the data. Within a bucket the bit planes
lie vertically (64 nodes a word), distances are counted for many nodes at once by
carry-save adders, and a block of 64 nodes is abandoned once every node in it that isn't yet linked is
beyond the radius of every query. A bucket gives a spanning star of each linked group, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import batches_of, missing_names, saved, small_batches, table

RADIUS = 2
SHINGLE = 3
SEED = 42
LARGE = 20_000
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; a text of fewer words is one shingle, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())], "<u8", len(starts))


def fingerprint_of(h: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes; 0 without any."""
    n = len(h)
    if not n:
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = h[i : i + (1 << 14)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half the XXH64 of the text's shingles, repeats included; 0 without words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, name: str = "fp", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the fingerprint as a (signed) long."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    columns = [F.col(f"`{c}`") for c in keep]
    (held,) = missing_names(docs, "fp_text")
    schema = docs.select(*columns, F.lit(0).cast("long").alias(name)).schema

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(len(keep))), "<u8", b.num_rows).view("<i8")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp, pa.int64())], names=[*b.schema.names[: len(keep)], name])

    return docs.select(*columns, F.col(f"`{text}`").alias(held)).mapInArrow(run, schema)


def within(fps: np.ndarray, radius: int = RADIUS, told: list | None = None) -> np.ndarray:
    """For each of ``fps`` (uint64, distinct) the index of the first of its linked group, found by breadth-first search. ``told``: see ``near``."""
    n = len(fps)
    words = (n + 63) // 64
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    bits = bits[:, (bits != bits[0]).any(axis=0)]  # planes on which all agree tell nothing, as those of a bucket's key
    planes = np.zeros((bits.shape[1], words * 8), np.uint8)
    packed = np.packbits(bits, axis=0, bitorder="little")
    planes[:, : packed.shape[0]] = packed.T
    planes = planes.view("<u8")
    flip = np.where(bits > 0, ONES, np.uint64(0))  # a node's own bit as a mask
    unseen = np.zeros(words * 64, np.uint8)
    unseen[:n] = 1
    unseen = np.packbits(unseen, bitorder="little").view("<u8")
    group = np.full(n, -1, np.int64)
    block = max(1, min(256, (1 << 18) // words))
    for first in range(n):
        if group[first] >= 0:
            continue
        group[first] = first
        unseen[first >> 6] &= ~(np.uint64(1) << np.uint64(first & 63))
        todo = [first]
        while todo:
            now, todo = todo[:block], todo[block:]
            linked = near(planes, flip[now], radius, unseen, told)
            if linked.any():
                unseen &= ~linked
                new = np.flatnonzero(np.unpackbits(linked.view(np.uint8), bitorder="little"))
                group[new] = first
                todo.extend(new.tolist())
    return group


def near(planes: np.ndarray, flip: np.ndarray, radius: int, wanted: np.ndarray, told: list | None = None) -> np.ndarray:
    """Of the nodes ``wanted`` (a bit each) those within ``radius`` of any of the queries, whose bits ``flip`` holds as masks.

    The distances of all nodes to all queries are counted plane by plane: ``sums[k]``
    holds bit k of each count, a carry out of the last makes a node ``over`` for good. Blocks are the words of 64 nodes;
    one in which every wanted node is beyond the radius of every query is abandoned. ``told``
    gets how many blocks were abandoned and how many were begun.
    """
    out = np.zeros(planes.shape[1], np.uint64)
    at = np.flatnonzero(wanted)
    told = [0, 0] if told is None else told
    told[1] += len(at)
    planes, live = planes[:, at], wanted[at]
    levels = radius.bit_length()
    sums, over = [np.zeros((len(flip), len(at)), np.uint64) for _ in range(levels)], np.zeros((len(flip), len(at)), np.uint64)
    for b in range(len(planes)):
        carry = planes[b][None, :] ^ flip[:, b][:, None]
        for k in range(levels):
            sums[k], carry = sums[k] ^ carry, sums[k] & carry
        over |= carry
        if b % 4 == 3:
            stay = (~beyond(sums, over, radius) & live).any(axis=0)
            if not stay.all():
                told[0] += int((~stay).sum())
                at, planes, live, over = at[stay], planes[:, stay], live[stay], over[:, stay]
                sums = [s[:, stay] for s in sums]
                if not len(at):
                    return out
    out[at] = np.bitwise_or.reduce(~beyond(sums, over, radius), axis=0) & live
    return out


def beyond(sums: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the counts above ``radius``: a bit-sliced comparison from the highest bit."""
    more, equal = over.copy(), ~over
    for k in reversed(range(len(sums))):
        if radius >> k & 1:
            equal = equal & sums[k]
        else:
            more |= equal & sums[k]
            equal = equal & ~sums[k]
    return more


def linked(rows: DataFrame, radius: int, large: int | None) -> DataFrame:
    """``rows`` (bucket, fp) dealt by bucket: (u, v, bucket) links of stars, or (fp, null, bucket) for the nodes of buckets above ``large``, of which no more than that and a batch are held."""

    def batch(u, v, key):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), v, pa.array(key, pa.int64())], names=["u", "v", "bucket"])

    def stars(f, key):
        f = np.unique(f)
        g = within(f, radius)
        own = np.flatnonzero(g != np.arange(len(f)))
        s = f.view(np.int64)
        return s[own], s[g[own]], np.full(len(own), key)

    def run(batches):
        key, held, size, passed = None, [], 0, False  # the bucket at hand; ``passed``: it is large, its nodes go on as they come

        def closed():
            found = stars(np.concatenate(held), key) if size > 1 and not passed else None
            return [found] if found is not None and len(found[0]) else []

        for b in batches:
            k, f = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            found, rest = [], []
            cut = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1, [len(k)]))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if key is None or k[i] != key:
                    found += closed()
                    key, held, size, passed = int(k[i]), [], 0, False
                held.append(f[i:j])
                size += j - i
                if passed or large is not None and size > large:
                    rest.append((np.concatenate(held), key))
                    held, passed = [], True
            if found:
                yield batch(np.concatenate([x[0] for x in found]), pa.array(np.concatenate([x[1] for x in found])), np.concatenate([x[2] for x in found]))
            for x, name in rest:
                yield batch(x.view(np.int64), pa.nulls(len(x), pa.int64()), np.full(len(x), name))
        for u, v, name in closed():
            yield batch(u, pa.array(v), name)

    return rows.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp").mapInArrow(run, "u long, v long, bucket long")


def quarters() -> list[tuple[int, int]]:
    return [(i, j) for i in range(4) for j in range(i + 1, 4)]


def links(nodes: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """Spanning links (u, v) of the distinct fingerprints ``nodes`` (fp) within ``radius`` (2 at most) bits."""
    assert 0 <= radius <= 2, "two of four quarters agree only up to two differing bits"
    spark = nodes.sparkSession
    part = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*[(F.lit(t) * F.lit(1 << 32) + part(i) * F.lit(1 << 16) + part(j)) for t, (i, j) in enumerate(quarters())])
    with batches_of(spark, 20_000):
        first = saved(linked(nodes.select(F.explode(keys).alias("bucket"), "fp"), radius, large), "simhash_links")
    found = first.where("v is not null").select("u", "v")
    again = first.where("v is null").select(F.col("u").alias("fp"), "bucket")
    if again.isEmpty():
        return found
    # the other two quarters of a table's key as one 32-bit number, cut into 11, 11 and 10 bits
    other = F.lit(None).cast("long")
    for t, (i, j) in enumerate(quarters()):
        a, b = [k for k in range(4) if k not in (i, j)]
        other = F.when(F.shiftright("bucket", 32) == t, part(a) * F.lit(1 << 16) + part(b)).otherwise(other)
    thirds = F.array(*[F.xxhash64(F.lit(s), F.col("bucket"), F.shiftright(other, s).bitwiseAND(F.lit((1 << n) - 1))) for s, n in ((0, 11), (11, 11), (22, 10))])
    second = linked(again.select(F.explode(thirds).alias("bucket"), "fp"), radius, None)
    with batches_of(spark, 20_000):
        return found.unionByName(saved(second.select("u", "v"), "simhash_links"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node that it reaches. Alternates large and small stars; each round is written to the shared folder."""
    spark = edges.sparkSession
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        star = e.join(low, "u")
        e = saved(star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (doc_id, fp): adds component_id, the smallest doc_id that is reachable by links of at most ``radius`` bits.

    Rows with one fingerprint are linked, also those without words (fingerprint 0). Null doc_ids take part but
    are never the smallest, unless alone (then null). Empty input, empty result.
    """
    by_fp = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    by_fp = saved(by_fp, "simhash_nodes")
    roots = components(links(by_fp.select("fp"), radius))
    named = by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select(F.col("fp").alias("n_fp"), "component_id")
    return prints.join(named, prints.fp == named.n_fp).drop("n_fp")


def kept_of_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group does: that with the smallest doc_id.

    Repeated rows of it stay once. Of a group of null doc_ids alone one row stays for each fingerprint. Columns are unchanged.
    """
    fp, k_id, k_fp = missing_names(docs, "fp", "k_id", "k_fp")
    narrow = with_fingerprint(docs, shingle, fp, keep=["doc_id"]).select("doc_id", F.col(fp).alias("fp"))
    groups = grouped(saved(narrow, "simhash_prints"), radius)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(k_id), F.col("fp").alias(k_fp)).distinct()
    rows = with_fingerprint(docs, shingle, fp)
    rows = rows.join(stay, (F.col(fp) == F.col(k_fp)) & F.col("doc_id").eqNullSafe(F.col(k_id)), "left_semi")
    return rows.dropDuplicates([fp, "doc_id"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = saved(with_fingerprint(docs, keep=["doc_id"]), "simhash_prints")
    out = grouped(prints)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
