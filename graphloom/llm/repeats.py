"""Removal of long repeated passages, by suffix arrays over the places where a passage can repeat.

A byte goes if a string of LENGTH bytes covers it that also starts earlier in the corpus, by (doc_id, place). Strings of that length are
dealt to tasks by content, so that equal ones meet, and no suffix array holds the corpus:

1. Anchors. Of the shorter strings (a third of LENGTH) within each window of LENGTH bytes the one with the least hash is the window's anchor,
   the leftmost if they tie: equal windows have equal anchors at equal places. Consecutive windows of one anchor are a context of at most
   5/3 LENGTH bytes; a text has one for each thirty-odd bytes.
2. Contexts are dealt by the hash of their anchor. Equal contexts (by 128 bits) are copies: all but the earliest go as they are, first within a
   task, where a passage of the whole corpus becomes one row, then over all.
3. Distinct contexts that share an anchor are fetched from the texts. All suffixes that start in their windows make an enhanced suffix array of a
   bucket; a stack scan gives its tree of common-prefix intervals, and an interval of LENGTH or more whose suffixes are preceded by
   different bytes is a maximal repeat within the contexts, with all its occurrences. Of these all but the earliest are covered.
   A context's first byte counts as preceded by a byte of its own, as what lies before belongs to another anchor.
4. An anchor of very many distinct contexts (the edges of a passage that a large share of all documents has) has no array: its windows are
   dealt one by one, by 128 bits of their bytes, again after a count within the task.

Repeats that go on beyond a context are found piece by piece; the removed runs of a document are the union of the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import missing_names, saved, small_batches, table
from graphloom.llm.line_dedup import NO_ID, keyed, member_filter, rarity, salt_bits
from graphloom.llm.shingles import HotTokens, Rarity, groups, mixed, text_bytes

LENGTH = 100
#: Distinct contexts of an anchor that share a suffix array.
BUCKET = 1 << 12
#: Contexts of whole buckets that a suffix array is made of, about.
CONTEXTS = 1 << 11
#: Windows that are looked at, and rows that are gathered before copies among them are told, at once.
STEP, HELD = 1 << 20, 1 << 19
#: A bound for places within a step: a hash keeps the bits above.
PLACE = (1 << 21) - 1
POWER = 0x9E3779B97F4A7C15
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """POWER^i and its inverse, modulo 2^64."""
    both = []
    for base in (POWER, pow(POWER, -1, 1 << 64)):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


class Rolling:
    """Hashes of all strings of ``size`` bytes of a buffer."""

    def __init__(self):
        self.up, self.down = powers(1 << 16)

    def __call__(self, b: np.ndarray, size: int) -> np.ndarray:
        if len(b) > len(self.up):
            self.up, self.down = powers(1 << int(len(b)).bit_length())
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTES[b] * self.up[: len(b)], out=sums[1:])
        n = len(b) - size + 1
        return mixed((sums[size:] - sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def least(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each window of ``size`` values, by windows of powers of two."""
    done = 1
    while 2 * done <= size:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (size - done)], x[size - done :]) if size > done else x


def contexts(column: pa.Array, length: int, roll: Rolling) -> tuple[np.ndarray, ...]:
    """(row, start, size, anchor, place): the contexts of the texts, ``start`` within the text and ``place`` within the column's bytes, ``anchor`` a hash."""
    b, at = text_bytes(column)
    end = np.repeat(at[1:], np.diff(at))
    gram = length // 3
    found = []
    for i in range(0, max(len(b) - length + 1, 0), STEP):
        part = b[i : i + STEP + length - 1]
        h = roll(part, gram)
        key = h & ~np.uint64(PLACE) | np.arange(len(h), dtype=np.uint64)
        anchor = (least(key, length - gram + 1) & np.uint64(PLACE)).astype(np.int64)
        s = np.flatnonzero(np.arange(i, i + len(anchor)) + length <= end[i : i + len(anchor)])
        if not len(s):
            continue
        a = anchor[s]
        new = np.ones(len(s), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1
        found.append((s[first] + i, s[last] - s[first] + length, h[a[first]]))
    place, size, anchor = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    row = np.searchsorted(at, place, "right") - 1
    return row, place - at[row], size, anchor, place


def digests(raw: bytes, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits of each raw[place : place + size], as two columns of longs."""
    digest = xxhash.xxh3_128_digest
    out = b"".join([digest(raw[i:j]) for i, j in zip(place.tolist(), (place + size).tolist())])
    return np.frombuffer(out, "<i8").reshape(-1, 2)


ROWS = "g long, c1 long, c2 long, did long, dh long, sl long"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


class Copies:
    """Gathers rows (ROWS as arrays) and tells copies among them: of equal c1, c2 the earliest go on, others become spans without a digest."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.n += len(columns[0])
        if self.n >= HELD:
            yield from self.told()

    def told(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        g, c1, c2, did, dh, sl = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        order = np.argsort(c1)
        same = c1[order][1:] == c1[order][:-1]
        may = np.zeros(len(order), bool)
        may[order[1:]] = same
        may[order[:-1]] |= same
        x = np.flatnonzero(may)
        x = x[np.lexsort((sl[x], dh[x], did[x], c2[x], c1[x]))]
        start = np.ones(len(x), bool)
        start[1:] = (c1[x][1:] != c1[x][:-1]) | (c2[x][1:] != c2[x][:-1])
        lead = x[np.flatnonzero(start)[np.cumsum(start) - 1]] if len(x) else x
        later = (did[x] != did[lead]) | (dh[x] != dh[lead]) | (sl[x] != sl[lead])  # a document that is repeated has no copies in itself
        go = np.ones(len(g), bool)
        go[x[~start]] = False
        yield pa.RecordBatch.from_arrays([pa.array(v[go]) for v in (g, c1, c2, did, dh, sl)], names=NAMES)
        y = x[later]
        if len(y):
            d, h, s = united(did[y], dh[y], sl[y])
            none = pa.nulls(len(d), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array((d ^ h) * 31 + s), none, none, pa.array(d), pa.array(h), pa.array(s)], names=NAMES)


def united(did: np.ndarray, dh: np.ndarray, sl: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each document with those that overlap or touch made one."""
    if not len(did):
        return did, dh, sl
    order = np.lexsort((sl, dh, did))
    did, dh, sl = did[order], dh[order], sl[order]
    new = np.ones(len(did), bool)
    new[1:] = (did[1:] != did[:-1]) | (dh[1:] != dh[:-1])
    doc = np.cumsum(new) - 1
    start = sl >> 32
    end = start + (sl & (1 << 31) - 1)
    reach = np.maximum.accumulate(doc << 32 | end)  # ends of earlier documents are below all of later ones
    cut = new.copy()
    cut[1:] |= (doc[1:] << 32 | start[1:]) > reach[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(did)) - 1
    return did[first], dh[first], start[first] << 32 | (reach[last] & (1 << 32) - 1) - start[first]


def anchored(docs: DataFrame, order: Rarity | None, length: int) -> DataFrame:
    """ROWS of the contexts of ``docs`` (did, dh, t): ``g`` the anchor, c1 and c2 the bits of the bytes, sl = start << 32 | many << 31 | size. Spans, which are copies within a task, have no c1 and c2.

    By ``order`` an anchor is one of ``many`` if it is very hot; it is then dealt by its contexts.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        roll, copies = Rolling(), Copies()
        for batch in batches:
            did, dh = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i, part in groups(batch.column(2)):
                row, start, size, anchor, place = contexts(part, length, roll)
                c1, c2 = digests(text_bytes(part)[0].tobytes(), place, size).T.copy()
                bits = salt_bits((order(anchor) >> np.uint64(56)).astype(np.int64)) if order is not None else np.zeros(len(anchor), np.uint64)
                low = (np.uint64(1) << bits) - np.uint64(1)
                g = anchor & ~low | c1.view(np.uint64) & low
                sl = start << 32 | (bits > 0).astype(np.int64) << 31 | size
                yield from copies.add(g.view(np.int64), c1, c2, did[row + i], dh[row + i], sl)
        yield from copies.told()

    return docs.mapInArrow(run, ROWS)


def frequent(docs: DataFrame, length: int) -> Rarity:
    """The anchors that are hot, by a count of all: one pass of the texts, of which a task tells its counts by bucket and its hottest alone."""
    small_batches(docs.sparkSession)

    def run(batches):
        roll, hot = Rolling(), HotTokens()
        for batch in batches:
            for _, part in groups(batch.column(0)):
                hot.add(contexts(part, length, roll)[3])
        tok, seen = hot.told()
        yield pa.RecordBatch.from_arrays([pa.array([*tok.tolist(), None], pa.int64()), pa.array([*seen.tolist(), None], pa.int64()), pa.array([None] * len(tok) + [hot.buckets.tolist()], pa.list_(pa.int32()))], names=["tok", "seen", "buckets"])

    return rarity(saved(docs.select("t").mapInArrow(run, "tok long, seen long, buckets array<int>"), "repeat_hot"))


def told(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``first``, the earliest of those equal in g, c1 and c2, or ``later``; a repeated document's own rows are neither. Dealt by ``by``."""
    w = Window.partitionBy("g", "c1", "c2").orderBy("did", "dh", "sl")
    out = rows.repartition(*by).withColumn("rn", F.row_number().over(w)).withColumn("rk", F.rank().over(w))
    alone = F.col("c1").isNull()
    return out.withColumn("first", (F.col("rn") == 1) & ~alone).withColumn("later", (F.col("rk") > 1) | alone).where("first or later").drop("rn", "rk")


def maximal_repeats(b: np.ndarray, at: np.ndarray, length: int, roll: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(size, count, context, offset): the maximal repeats of ``length`` or more among the suffixes of contexts b[at[i]:at[i + 1]] that have at least ``length`` bytes.

    ``size`` and ``count`` have a value a repeat, ``context`` and ``offset`` an occurrence, in that order.
    """
    none = np.empty(0, np.int64)
    size = np.diff(at)
    n = size - length + 1
    context = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
    start = at[context] + offset
    # only suffixes whose first bytes occur twice are of any repeat
    h = roll(b, length)[start]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    context, offset, start = context[twice], offset[twice], start[twice]
    if not len(start):
        return none, none, none, none
    # the suffixes in order: bytes count from 1 (none is 255), so that 0 ends a suffix
    wide = int(size.max())
    held = np.zeros(len(b) + wide, np.uint8)
    held[: len(b)] = b + 1
    rows = np.lib.stride_tricks.sliding_window_view(held, wide)[start]
    own = size[context] - offset
    rows[np.arange(wide)[None, :] >= own[:, None]] = 0
    order = np.argsort(rows.view(f"S{wide}").ravel(), kind="stable")
    rows, own, context, offset, start = rows[order], own[order], context[order], offset[order], start[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    common = np.minimum(common, np.minimum(own[1:], own[:-1]))
    common = np.where(common >= length, common, 0)
    left = np.where(offset > 0, b[np.maximum(start - 1, 0)].astype(np.int64), 256 + np.arange(len(start)))
    found = intervals(common.tolist(), left.tolist())
    if not found:
        return none, none, none, none
    long, low, high = np.array(found, np.int64).T
    count = high - low + 1
    member = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return long, count, context[member], offset[member]


def intervals(common: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of the intervals of a suffix array that more than one byte precedes. ``common``: of neighbours; 0 parts them. A scan with a stack of open intervals."""
    out = []
    sizes, lows, lefts = [0], [0], [-1]  # of open intervals, outermost first; a left of -1 is more than one byte
    for i, now in enumerate([*common, 0]):
        low, own = i, left[i]
        while sizes[-1] > now:
            size, low, before = sizes.pop(), lows.pop(), lefts.pop()
            own = own if before == own else -1
            if own == -1:
                out.append((size, low, i))
        if not now:
            continue
        if sizes[-1] < now:
            sizes.append(now)
            lows.append(low)
            lefts.append(own)
        elif lefts[-1] != own:
            lefts[-1] = -1
    return out


def fetched(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(g, many, did, dh, start, bytes) of the contexts ``firsts`` (g, did, dh, sl, many): the texts of their documents alone are dealt."""
    wanted = firsts.groupBy("did", "dh").agg(F.collect_list(F.struct("g", "sl", "many")).alias("of"))  # contexts of one document
    wanted = saved(wanted, "repeat_wanted")
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                did, dh, of = (batch.column(k)[i : i + 1] if k < 2 else batch.column(k)[i].values for k in (0, 1, 3))
                raw = batch.column(2)[i].as_buffer().to_pybytes()
                sl = of.field("sl").to_numpy()
                start = sl >> 32
                parts = [raw[x:y] for x, y in zip(start.tolist(), (start + (sl & (1 << 31) - 1)).tolist())]
                same = [c.take(pa.array(np.zeros(len(of), np.int64))) for c in (did, dh)]
                yield pa.RecordBatch.from_arrays([of.field("g"), of.field("many"), *same, pa.array(start), pa.array(parts, pa.binary())], names=["g", "many", "did", "dh", "start", "bytes"])

    some = docs.where(member_filter(wanted, "did", "dh")).join(wanted, ["did", "dh"]).select("did", "dh", "t", "of")
    return some.mapInArrow(run, "g long, many boolean, did long, dh long, start long, bytes binary")


def grouped(found: DataFrame, length: int, spans: bool = False) -> DataFrame:
    """(repeat, did, dh, sl, later): the maximal repeats of the contexts ``found``, each with all its occurrences there; ``repeat`` tells them apart, ``later`` all but the earliest.

    With ``spans`` only (did, dh, sl), the later occurrences, those of a document that overlap made one.
    """
    wanted = "did long, dh long, sl long" if spans else "repeat long, did long, dh long, sl long, later boolean"
    found.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CONTEXTS))

    def scan(held: list[pa.RecordBatch], roll: Rolling) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held).combine_chunks()
        did, dh, start = (t.column(c).to_numpy() for c in ("did", "dh", "start"))
        b, at = text_bytes(pa.concat_arrays(t.column("bytes").chunks))
        size, count, context, offset = maximal_repeats(b, at, length, roll)
        if not len(size):
            return None
        doc = np.unique(np.stack([did, dh], axis=1), axis=0, return_inverse=True)[1].ravel()  # in order
        place = start[context] + offset
        key = doc[context] << 32 | place
        first = np.cumsum(count) - count
        later = key > np.repeat(np.minimum.reduceat(key, first), count)
        sl = place << 32 | np.repeat(size, count)
        if spans:
            d, h, x = united(did[context][later], dh[context][later], sl[later])
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(h), pa.array(x)], names=["did", "dh", "sl"])
        name = np.array([xxhash.xxh3_64_intdigest(b[at[c] + o : at[c] + o + s].tobytes()) for c, o, s in zip(context[first].tolist(), offset[first].tolist(), size.tolist())], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, count)), pa.array(did[context]), pa.array(dh[context]), pa.array(sl), pa.array(later)], names=["repeat", "did", "dh", "sl", "later"])

    def run(batches):
        roll, held = Rolling(), []  # the rows of the last bucket, which may go on
        for batch in batches:
            g = batch.column(0).to_numpy()
            if not len(g):
                continue
            last = int(np.argmax(g == g[-1]))
            if last or held and held[-1].column(0)[-1].as_py() != g[0]:
                whole = [*held, batch.slice(0, last)]
                held = []
                if (out := scan(whole, roll)) is not None:
                    yield out
            held.append(batch.slice(last))
        if held and (out := scan(held, roll)) is not None:
            yield out

    return found.repartition("g").sortWithinPartitions("g").mapInArrow(run, wanted)


def single_windows(found: DataFrame, length: int) -> DataFrame:
    """(did, dh, sl) of the windows of the contexts ``found`` that are later than an equal one."""
    found.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CONTEXTS))

    def run(batches):
        copies = Copies()
        for batch in batches:
            did, dh, start = (batch.column(k).to_numpy() for k in (2, 3, 4))
            for i, raw in enumerate(batch.column(5).to_pylist()):
                n = len(raw) - length + 1
                c1, c2 = digests(raw, np.arange(n), np.full(n, length)).T.copy()
                yield from copies.add(c1, c1, c2, np.full(n, did[i]), np.full(n, dh[i]), np.arange(start[i], start[i] + n) << 32 | length)
        yield from copies.told()

    return told(found.mapInArrow(run, ROWS), "g").where("later").select("did", "dh", "sl")


def dealt(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of documents ``rows`` (did, dh, t): spans (did, dh, sl) of the copies of whole contexts, and the contexts that share an anchor with others (see ``fetched``)."""
    order = frequent(rows, length)
    many = (F.shiftright("sl", 31).bitwiseAND(F.lit(1))) == 1
    size = F.lit(~(1 << 31))
    t = told(anchored(rows, order, length), "g")
    t = t.withColumn("d", F.sum(F.col("first").cast("int")).over(Window.partitionBy("g")))
    t = saved(t.where(F.col("later") | many | (F.col("d") > 1)).select("g", "did", "dh", F.col("sl").bitwiseAND(size).alias("sl"), "first", (many | (F.col("d") > BUCKET)).alias("many")), "repeat_rows")
    return t.where("not first").select("did", "dh", "sl"), saved(fetched(rows, t.where("first")), "repeat_contexts")


def repeat_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(repeat, doc_id, start, size, later) of the occurrences of each maximal repeat among distinct contexts: bytes [start, start + size) of the document's text.

    ``repeat`` is a hash of its bytes. Copies of a whole context stand behind its earliest occurrence, and repeats among more contexts of an anchor than a suffix array takes aren't among them.
    """
    found = dealt(keyed(docs, text, key), length)[1]
    start, size = F.shiftright("sl", 32), F.col("sl").bitwiseAND(F.lit((1 << 31) - 1))
    return grouped(found.where("not many"), length).select("repeat", F.nullif("did", F.lit(NO_ID)).alias("doc_id"), start.alias("start"), size.alias("size"), "later")


def found_repeats(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans (did, dh, sl) of documents ``rows`` (did, dh, t) that cover all bytes to remove."""
    copies, found = dealt(rows, length)
    return copies.unionByName(grouped(found.where("not many"), length, spans=True)).unionByName(single_windows(found.where("many"), length))


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (long) and ``kept`` (binary), the bytes of the text that stay.

    Texts are read as UTF-8 bytes, null ones as empty; texts of fewer than ``length`` bytes stay whole. Null doc_ids come last in the order,
    rows that share a doc_id follow a hash of their texts. Rows that repeat a doc_id and text are one document: they are cut alike, and aren't
    copies of each other. Of columns that bear the added names, the added ones stay. Empty input, empty result.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    rows = keyed(docs, text, key)
    did, dh, own, at = missing_names(docs, "did", "dh", "own_text", "own_spans")
    spans = found_repeats(rows, length).groupBy(F.col("did").alias(did), F.col("dh").alias(dh)).agg(F.collect_set("sl").alias(at))  # of one document
    spans = saved(spans, "repeat_spans")
    some = member_filter(spans, did, dh)
    names = docs.columns
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    held = docs.withColumn(did, F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID))).withColumn(dh, F.xxhash64(t))
    rest = [F.col(f"`{c}`") for c in names]
    touched = held.where(some).join(spans, [did, dh], "left").select(*rest, t.alias(own), at)
    small_batches(docs.sparkSession)
    none = F.lit(0).cast("long")
    whole = held.where(~some).select(*rest, F.octet_length(t).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), t.cast("binary").alias("kept"))
    k = len(names)

    def run(batches):
        for batch in batches:
            n, gone, runs, kept = [], [], [], []
            for x, s in zip(batch.column(k), batch.column(k + 1)):
                raw = x.as_buffer().to_pybytes()
                n.append(len(raw))
                if not s.is_valid:
                    gone.append(0)
                    runs.append(0)
                    kept.append(raw)
                    continue
                sl = s.values.to_numpy()
                zero = np.zeros(len(sl), np.int64)
                sl = united(zero, zero, sl)[2]
                start, size = sl >> 32, sl & (1 << 31) - 1
                gone.append(int(size.sum()))
                runs.append(len(sl))
                edges = [0, *np.stack([start, start + size], axis=1).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *[pa.array(v, pa.int64()) for v in (n, gone, runs)], pa.array(kept, pa.binary())], names=[*batch.schema.names[:k], "n_bytes", "n_removed", "n_spans", "kept"])

    return whole.unionByName(touched.mapInArrow(run, whole.schema))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
