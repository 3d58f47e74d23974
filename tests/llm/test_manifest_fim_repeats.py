"""The manifest, fill-in-the-middle and repeated passages against plain versions of their rules."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import fill_middle, merkle, repeats

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def clash(df):
    for n in ("tree", "rank", "n", "h", "data", "key", "leaf", "root", "form", "fim", "fim_text", "fim_1", "did", "dh", "kept", "own_text", "n_bytes"):
        df = df.withColumn(n, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- manifest


def leaf(row, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), row[4]) if lower and row[4] is not None else row[4]
    told = [None if x is None else str(x) for x in (row[0], row[1], row[2], row[3], text)]
    return sha("".join("-" if x is None else f"{len(x.encode())}:{x}" for x in told))


def tree(leaves):
    """The top of a tree and for each leaf its (place, run) pairs from below."""
    paths, spots, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for i, at in enumerate(spots):
            paths[i].append((at % 16, runs[at // 16]))
            spots[i] = at // 16
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[s] = (own, *tree([leaf(r) for r in own]))
    root, upper = tree([made[s][1] for s in names])
    out = []
    for s, up in zip(names, upper):
        own, sub, paths = made[s]
        for r, path in zip(own, paths):
            path = path + up
            proof = sha("".join(x for at, run in path for i, x in enumerate(run) if i != at))
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for at, run in path:
                h = sha("".join([*run[:at], h, *run[at + 1 :]]))
            out.append((r[0], leaf(r), sub, root, proof, h, h == root))
    return out


def told(df):
    return sorted(map(repr, map(tuple, df.collect())))


def run_manifest(spark, rows, tmp_path, df=None):
    (spark.createDataFrame(rows, DOCS) if df is None else df).write.parquet(f"{tmp_path}/documents.parquet")
    return told(merkle.op11_merkle_manifest(spark, str(tmp_path)))


def rows_of(n, seed=0, spread=1):
    r = random.Random(seed)
    text = lambda: "".join(r.choice("abcXYZ é\n") for _ in range(r.randint(0, 30)))
    return [(i * spread, None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 40}é", r.choice(["en", None]), r.choice([3, None]), None if i % 17 == 0 else text()) for i in range(n)]


def test_manifest(spark, tmp_path):
    rows = rows_of(700)
    rows += [rows[5], rows[5], (None, "hot", None, None, None), (None, "hot", "x", 1, "B"), (-7, "hot", None, 2, "A"), (1 << 62, "hot", "e", 2, "A"), (3, "", "e", 2, "A"), (12, "hot", "z", 2, "Q")]
    got = run_manifest(spark, rows, tmp_path, clash(spark.createDataFrame(rows, DOCS).drop("n")))
    assert got == sorted(map(repr, manifest(rows)))
    assert {x.endswith("True)") for x in got} == {True, False}


def test_manifest_of_ids_that_tie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "TIES", 8)
    rows = [(5, "a", None, i, f"t{i}") for i in range(300)] + [(None, "a", None, i, "q") for i in range(40)] + rows_of(60, spread=1 << 40)
    assert run_manifest(spark, rows, tmp_path) == sorted(map(repr, manifest(rows)))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_manifest_of_one_source(spark, tmp_path, n):
    rows = [(i, "one", "en", 1, "A") for i in range(n)]
    assert run_manifest(spark, rows, tmp_path) == sorted(map(repr, manifest(rows)))


def test_manifest_of_many_sources(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "SOURCES", 50)
    rows = [(i, f"s{i}", "en", 1, "Ab") for i in range(300)]
    assert run_manifest(spark, rows, tmp_path) == sorted(map(repr, manifest(rows)))


def test_manifest_empty(spark, empty, tmp_path):
    assert run_manifest(spark, [], tmp_path, empty) == []


# ---- fill in the middle


def fim(doc_id, text):
    t = text or ""
    k = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    i, j = sorted((h[0] % (len(k) + 1), h[1] % (len(k) + 1)))
    p, m, s = ("".join(x) for x in (k[:i], k[i:j], k[j:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(k), "plain", None, None, t
    if h[3] % 100 < 20:
        return doc_id, len(k), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(k), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts_of(n, seed=1):
    r = random.Random(seed)
    al = ["a", "B", "zz", " ", "\n", "é", "日", "😀", "<", "S", ">", "<S", "M>", "1", "\r\n", "\0", "word"]
    return [(i, None if i % 19 == 0 else "".join(r.choice(al) for _ in range(r.randint(0, 80)))) for i in range(n)]


def test_fill_in_middle(spark, tmp_path):
    rows = texts_of(400) + [(900, "x<P>y"), (901, "<M>"), (902, ""), (None, "two words"), (3, "two words"), (903, "ab é" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fill_middle.filled(clash(df))
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "fim", fill_middle.restored(F.col("fim"), F.col("form")).alias("back"), "tree").collect()
    assert sorted(repr(tuple(x)[:6]) for x in got) == sorted(repr(fim(*x)) for x in rows)
    assert sorted((x.doc_id or -1, x.back) for x in got) == sorted((a or -1, b or "") for a, b in rows)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {(x.doc_id, x.output_sha256) for x in fill_middle.op12_fill_in_middle(spark, str(tmp_path)).collect()} == {(x[0], sha(x[5])) for x in (fim(*y) for y in rows)}


def test_fill_in_middle_empty(spark, empty):
    assert fill_middle.filled(empty).count() == 0


def test_rank_and_select():
    r = np.random.default_rng(0)
    for n, share in ((1, 1.0), (63, 0.5), (64, 0.5), (5000, 0.01), (5000, 0.9), (513, 1.0)):
        bits = r.random(n) < share
        bits[-1] = True
        b = fill_middle.Bits(np.packbits(bits, bitorder="little"))
        before = np.concatenate([[0], np.cumsum(bits)])
        assert (b.rank(np.arange(n + 1)) == before).all()
        assert (b.select(np.arange(bits.sum())) == np.flatnonzero(bits)).all()


def test_boundaries_across_steps(monkeypatch):
    monkeypatch.setattr(fill_middle, "STEP", 64)
    rows = [t or "" for _, t in texts_of(60, 4)] + ["abc" * 200]
    one, two = np.arange(len(rows)) * 7919, np.arange(len(rows)) * 104729
    n, p, m, pc, mc = fill_middle.cut(pa.array(rows), one, two)
    for i, t in enumerate(rows):
        k = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        a, b = sorted((int(one[i]) % (len(k) + 1), int(two[i]) % (len(k) + 1)))
        assert (n[i], p[i], m[i], pc[i], mc[i]) == (len(k), len("".join(k[:a]).encode()), len("".join(k[:b]).encode()), len("".join(k[:a])), len("".join(k[a:b])))


# ---- repeats


def without(rows, length):
    seen, out = {}, {}
    rows = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    for d, t in rows:
        b = t.encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], (d, p))
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] != (d, p):
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[d] = (len(b), sum(gone), runs, bytes(x for k, x in enumerate(b) if not gone[k]))
    return out


def passages(seed, length):
    r = random.Random(seed)
    rnd = lambda n, al="abcdefghij éж": "".join(r.choice(al) for _ in range(n))
    fam, rows = [rnd(4 * length) for _ in range(4)], []
    for i in range(120):
        k = r.random()
        if k < 0.3:
            t = rnd(r.randint(0, 5 * length))
        elif k < 0.6:
            f, a = r.choice(fam), r.randint(0, 3 * length)
            t = rnd(r.randint(0, length)) + f[a : a + r.randint(length // 2, 4 * length)] + rnd(r.randint(0, length))
        elif k < 0.75:
            t = list(r.choice(fam))
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice("xyz")
            t = "".join(t)
        elif k < 0.85:
            t = rnd(7) * r.randint(1, length // 2)
        else:
            t = rnd(r.randint(length, 2 * length), "ab")
        rows.append((i, t))
    rows += [(200, rows[3][1]), (201, rows[40][1] * 2), (202, "-" * 7 * length), (203, "-" * 3 * length), (204, ""), (205, None), (None, fam[0])]
    r.shuffle(rows)
    return rows


def kept(df, length=repeats.LENGTH):
    return {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in repeats.without_repeats(df, length=length).collect()}


@pytest.mark.parametrize("bucket, held", [(1 << 12, 1 << 19), (2, 40)])
def test_repeats(spark, monkeypatch, bucket, held):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    monkeypatch.setattr(repeats, "HELD", held)
    rows = passages(bucket, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(df) == without(rows, 100)


def test_repeats_of_other_length_with_clashing_columns(spark):
    rows = passages(3, 45)
    assert kept(clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(7), 45) == without(rows, 45)


def test_repeats_of_repeated_rows(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcdef") for _ in range(300))
    rows = [(1, long), (1, long), (2, long), (3, long[:150] + "!" + long[150:])]
    got = [(x.doc_id, x.n_removed) for x in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 0), (1, 0), (2, 300), (3, 300)]


def test_repeats_across_steps(monkeypatch, spark):
    monkeypatch.setattr(repeats, "STEP", 150)
    rows = passages(9, 100)[:40]
    found, roll = {}, repeats.Rolling()
    row, start, size, *_ = repeats.contexts(pa.array([t for _, t in rows]), 100, roll)
    for r, s, n in zip(row.tolist(), start.tolist(), size.tolist()):
        found.setdefault(r, set()).update(range(s, s + n - 99))
    assert found == {i: set(range(len((t or "").encode()) - 99)) for i, (_, t) in enumerate(rows) if len((t or "").encode()) >= 100}


def test_a_very_long_text(spark):
    r = random.Random(7)
    one = "".join(r.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, one), (2, one[600_000:1_250_000]), (3, "z" * 150 + one[1_048_400:1_048_700]), (4, "Y" * 99 + "X" + one[1_048_500:1_048_700])]
    got = kept(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [got[k][1] for k in (1, 2)] == [0, 650_000]
    assert got[3] == (450, 449, 1, b"z")  # the run of z repeats itself
    assert got[4] == (300, 200, 1, b"Y" * 99 + b"X")


def test_repeats_empty(spark, empty):
    assert repeats.without_repeats(empty).count() == 0


def test_maximal_repeats():
    """Each maximal repeat of whole contexts with all its occurrences, as a search for every string finds them."""
    r = random.Random(4)
    for _ in range(30):
        own = [bytes(r.choice(b"ab") for _ in range(r.randint(12, 30))) for _ in range(r.randint(1, 6))]
        b, at = np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        size, count, context, offset = repeats.maximal_repeats(b, at, 8, repeats.Rolling())
        got, i = set(), 0
        for n, k in zip(size.tolist(), count.tolist()):
            got.add((n, frozenset(zip(context[i : i + k].tolist(), offset[i : i + k].tolist()))))
            i += k
        where = {}
        for c, x in enumerate(own):
            for o in range(len(x) - 7):
                for n in range(8, len(x) - o + 1):
                    where.setdefault(x[o : o + n], set()).add((c, o))
        want = set()
        for x, spots in where.items():
            left = {own[c][o - 1] if o else (c, o) for c, o in spots}
            right = {own[c][o + len(x)] if o + len(x) < len(own[c]) else (c, o) for c, o in spots}
            if len(spots) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(x), frozenset(spots)))
        assert got == want


def test_repeat_groups(spark):
    """Occurrences hold the bytes of their repeat, and the groups cover what is removed but copies of whole contexts."""
    rows = passages(11, 100)
    text = {d: (t or "").encode() for d, t in rows}
    got = repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.repeat, []).append((r.later, r.doc_id, r.start, text[r.doc_id][r.start : r.start + r.size]))
    assert by
    for found in by.values():
        assert len({x[3] for x in found}) == 1 and len(found) > 1 and len(found[0][3]) >= 100
        first = min(found, key=lambda x: (x[1] is None, x[1] or 0, x[2]))
        assert all(x[0] == (x[1:3] != first[1:3]) for x in found)
