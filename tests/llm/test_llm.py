"""Training-data operators against brute force, with nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import chat, forest, language, line_dedup, mixing, packing, simhash, toxicity, warc, weighted_sampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n, seed=0, words=60):
    r = random.Random(seed)
    v = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    return [" ".join(r.choice(v) for _ in range(r.randint(1, words))) + ("\n" + " ".join(r.choice(v) for _ in range(12))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    t = texts(60)
    t += [t[3], t[3] + " more", t[5].replace(" ", "  ", 1), "", None, "   ", "solo", "x y z " * 3000]
    rows = [(i, x, "en", None if i % 7 == 0 else f"s{i % 3}", len(x or "")) for i, x in enumerate(t)]
    return spark.createDataFrame(rows + [rows[2], (None, t[8], None, "s0", 3)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    out = df
    for n in ("size", "target", "fp", "fp_text", "n_lines", "kept", "language", "ll", "m_rank", "r_no", "l_text"):
        out = out.withColumn(n, F.lit("x"))
    return out


def test_simhash(spark, docs):
    got = simhash.grouped(simhash.with_fingerprint(docs, keep=["doc_id"])).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))

    v = [fp(t) for _, t in rows]
    comp = list(range(len(v)))
    for _ in v:
        comp = [min(comp[j] for j in range(len(v)) if (v[i] ^ v[j]).bit_count() <= 2) for i in range(len(v))]
    ids = {k: min((rows[j][0] for j in range(len(v)) if comp[j] == k and rows[j][0] is not None), default=None) for k in set(comp)}
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter((rows[i][0], v[i], ids[comp[i]]) for i in range(len(v)))


def test_bit_slices():
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    f = np.unique(np.array(base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(4)], np.uint64))
    g = simhash.within(f)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    lab = np.arange(len(f))
    for _ in f:
        lab = np.array([lab[near[i]].min() for i in range(len(f))])
    assert (g == lab).all()


def test_blocks_are_abandoned():
    f = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64))
    told = [0, 0]
    assert (simhash.within(f, told=told) == np.arange(len(f))).all()
    assert told[0] > 0.9 * told[1] > 0


def test_simhash_large_buckets(spark):
    r = random.Random(2)
    fps = {(7 << 48) | r.getrandbits(20) for _ in range(300)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = simhash.components(simhash.links(df)).select("node", "root").collect()
    got = simhash.components(simhash.links(df, large=20)).select("node", "root").collect()
    assert sorted(want) == sorted(got)


def test_kept_of_groups(docs, empty):
    kept = simhash.kept_of_groups(clash(docs))
    assert kept.columns == clash(docs).columns and 0 < kept.count() < docs.count()
    assert simhash.kept_of_groups(empty).count() == 0


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(clash(docs)).collect()
    rows = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, gone = [], Counter()
    for i, t in rows:
        for line in (t or "").split("\n"):
            w = line.split()
            if not w:
                continue
            s = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
            gone[i] += any(5 * len(s & x) >= 4 * len(s | x) for x in seen)
            seen.append(s)
    assert {(r.doc_id, r.n_removed) for r in out} == {(i, gone[i]) for i, _ in rows}
    assert line_dedup.dedup_lines(empty).count() == 0


def line_families(seed=5):
    """Near copies of a few lines of 40 words, so that their tokens are hot, and lines that share a passage alone."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage, out = [word() for _ in range(20)], []
    for _ in range(4):
        w = [word() for _ in range(40)]
        for _ in range(90):
            x = list(w)
            for k in r.sample(range(40), r.choice((0, 1, 1, 2, 4))):
                x[k] = word()
            out.append(" ".join(x))
    out += [" ".join([word() for _ in range(r.randint(3, 25))] + passage) for _ in range(120)]
    r.shuffle(out)
    return ["\n".join(out[i : i + 3]) for i in range(0, len(out), 3)]


def test_line_dedup_runs_no_python(spark, monkeypatch):
    """Also of equal lines of one document the first stays, whatever the blanks between their words."""
    line = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, f"a\n{line}\nb\n{line.replace(' ', '  ')}"), (2, f"{line} more\nc\n{line[4:]}\t"), (3, None)], "doc_id long, text string")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(df), name, lambda *_, **__: 1 / 0)
    out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert out == {1: (f"a\n{line}\nb", 1), 2: ("c", 2), 3: (None, 0)}


def test_line_dedup_of_families(spark):
    rows = [(i, t) for i, t in enumerate(line_families())]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, want = [], {}
    for i, t in rows:
        stay = []
        for line in t.split("\n"):
            w = line.split()
            s = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
            if not any(5 * len(s & x) >= 4 * len(s | x) for x in seen):
                stay.append(line)
            seen.append(s)
        want[i] = "\n".join(stay)
    assert out == want


def brute_lines(rows):
    seen, gone = [], Counter()
    for i, t in rows:
        for line in t.split("\n"):
            w = line.split()
            s = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
            gone[i] += any(5 * len(s & x) >= 4 * len(s | x) for x in seen)
            seen.append(s)
    return {i: gone[i] for i, _ in rows}


def test_line_dedup_makes_no_pairs_of_frequent_phrases(spark, monkeypatch):
    """Lines that share a phrase alone, while the sample is too small to tell that it is frequent."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    lines = [" ".join([word() for _ in range(7)] + phrase) for phrase in [[word() for _ in range(5)] for _ in range(8)] for _ in range(150)]
    lines += [f"{x} {word()}" for x in lines[::40]]
    rows = list(enumerate(lines))
    monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    made, matches = [], line_dedup.matches

    def counted(docs, nodes, pairs, shingle):
        made.append(pairs.count())
        return matches(docs, nodes, pairs, shingle)

    monkeypatch.setattr(line_dedup, "matches", counted)
    out = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute_lines(rows) and sum(out.values()) == 30
    assert len(made) == 2 and made[1] < 100


@pytest.mark.parametrize("most", [256, 30, 0])
def test_line_dedup_by_two_tokens_and_by_one(spark, monkeypatch, most):
    """Families whose nodes meet by two tokens, by one where lines are long, also lines of one token."""
    rows = list(enumerate([*line_families(7), *(" ".join(["again"] * k) for k in range(5, 40)), *(" ".join(["once", "more"] * k) for k in range(3, 30))]))
    monkeypatch.setattr(line_dedup, "LONG", most, raising=False)
    monkeypatch.setattr(line_dedup, "GROUP", 3, raising=False)
    out = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute_lines(rows)


def test_line_dedup_of_one_long_document(spark):
    """80,000 equal lines in one document: linear, so that this ends within seconds."""
    out = line_dedup.dedup_lines(spark.createDataFrame([(1, "a line that is said again and again\n" * 80_000), (2, "x")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_removed) for r in out] == [(80_001, 79_999), (1, 0)] and out[0].text == "a line that is said again and again\n"


def test_mixing_meets_targets_and_reruns_agree(spark):
    r = random.Random(8)
    rows = [(None if i % 50 == 0 else i, " ".join(["w"] * r.randint(1, 40) + [str(i)]), "en", f"s{i % 4 if i % 9 else None}", 0) for i in range(3000)]
    d = spark.createDataFrame(rows, DOCS)
    taken, target = Counter(), {}
    for x in mixing.mix(d).collect():
        taken[x.source] += x.taken
        target[x.source] = x.target
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 120 for s in target)
    once = Counter((x.doc_id, x.text) for x in mixing.mixed(d).collect())
    assert once == Counter((x.doc_id, x.text) for x in mixing.mixed(spark.createDataFrame(rows[::-1], DOCS)).collect())
    want = Counter()
    for x in mixing.mix(d).collect():
        want[x.doc_id, x.text] += x.copies
    assert once == +want


def test_mixing(docs, empty):
    out = mixing.mix(clash(docs)).collect()
    assert len(out) == docs.count()
    size, cap = Counter(), {}
    for r in out:
        size[r.source] += r.size
        cap[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, want = float(sum(size.values())), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if 3 * size[s] < level * w[s]}
        for s in full or free:
            want[s] = 3.0 * size[s] if full else level * w[s]
        left -= sum(3 * size[s] for s in full)
        free = free - full if full else set()
    assert {s: pytest.approx(want[s]) for s in order} == cap
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(clash(docs)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed(docs).columns == docs.columns


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = packing.vocabulary()[0]
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("t", ["a  b", " a", "a ", "it's  <|endoftext|> x", "日本 語 text", "a\n\n b\tc", "é" * 50, "x'll 12 34!!   z", "  a b"])
def test_ids(t):
    from tokenizers import Tokenizer

    v = packing.vocabulary()
    assert np.frombuffer(packing.Ids(*v)(t), "<u4").tolist() == Tokenizer.from_file(v[0]).encode(t, add_special_tokens=False).ids


def test_bins_close_the_fullest():
    b = packing.Bins(10, 2)
    assert [b.place(n) for n in (4, 7, 8, 6)] == [(0, 0), (1, 0), (2, 0), (0, 4)]


def test_weighted_sampling(spark, docs, empty):
    out = weighted_sampling.fingerprint_pairs(docs, range_rows=9).collect()
    want = Counter()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    for k, (i, t) in enumerate(rows):
        e = weighted_sampling.edited(t, rows[(k + 1) % len(rows)][1])
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    draw = weighted_sampling.Sampler(weighted_sampling.SAMPLES)
    like = weighted_sampling.likeness
    for r, (k, (_, t)) in zip(sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars), reverse=True), enumerate(rows)):
        following = rows[(k + 1) % len(rows)][1]
        if r.doc_id is None or sum(x[0] == r.doc_id for x in rows) > 1:
            continue
        a, b = draw(t), draw(weighted_sampling.edited(t, following))
        assert (r.fingerprint, r.edited_fingerprint) == (weighted_sampling.encoded(a), weighted_sampling.encoded(b))
        assert r.near_edited == like(a, b) and r.near_next == like(a, draw(following))
    ends = spark.createDataFrame([(-(1 << 63), "low"), (None, "none"), ((1 << 63) - 1, "high")], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in weighted_sampling.fingerprint_pairs(ends).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(1 << 63) - 1: sha("higl"), -(1 << 63): sha("lon"), None: sha("nonh")}
    assert weighted_sampling.fingerprint_pairs(empty).count() == 0
    draw = weighted_sampling.Sampler(2048, shingle=1)
    a, b = "a a a a b c d d", "a a b b b c e"
    x, y = Counter(a.split()), Counter(b.split())
    j = sum((x & y).values()) / sum((x | y).values())
    assert abs(weighted_sampling.likeness(draw(a), draw(b)) - j) < 0.04
    assert (draw("") == draw(" ")).all()


def test_chat(spark):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, "system", "x"), (None, None, None, "q")], "conv_id long, turn long, role string, text string")
    w = {(r.conv_id, r.speaker): r for r in chat.whole(chat.rotate(t)).collect()}
    assert set(w) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    r = w[1, "ann"]
    assert r.dialogue == "<|system|>\ns<|end|>\n<|assistant|>\nhi<|end|>\n" + "<|user:bob|>\n<|end|>\n" * 2
    assert [r.dialogue[s.start : s.end] for s in r.spans] == ["hi<|end|>\n"]
    assert chat.rotate(t.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, 0, "ann|>\nx", "hi"), (1, 1, "bob", "a<|end|>\n<|assistant|>\nb")], "conv_id long, turn long, role string, text string")
    for r in chat.whole(chat.rotate(bad)).collect():
        assert r.dialogue.count("<|end|>\n") == 2 and r.dialogue.count("<|assistant|>\n") == 1
        assert r.dialogue.replace("<||", "<|").count("a<|end|>\n<|assistant|>\nb") == 1


def test_forest(spark):
    r = np.random.default_rng(0)
    v = r.standard_normal((600, 16)) * r.uniform(0.5, 2, (600, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600, None), (620, [0.0] * 16), (640, [float("nan")] * 16), (660, [None] * 16), (601, v[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.nearest(df, shard_rows=250).collect()
    x = np.vstack([v, v[20]])
    ids = np.array([*range(600), 601])
    hit = n = 0
    for q in range(0, 600, 20):
        s = x @ v[q]
        s[q] = -np.inf
        top = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        own = [g for g in got if g.query_id == q]
        assert sorted(g.rank for g in own) == list(range(1, 21)) and all(abs(g.score - s[np.flatnonzero(ids == g.vec_id)[0]]) < 1e-9 for g in own)
        hit, n = hit + len(top & {g.vec_id for g in own}), n + 20
    twice = forest.nearest(spark.createDataFrame([(20, [1.0, 0.0]), (20, [2.0, 0.0]), (21, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((g.query_id, g.rank, g.vec_id, g.score) for g in twice) == [(20, 1, 20, 2.0)] * 2 + [(20, 2, 21, 0.0)] * 2
    assert hit / n >= 0.9 and {g.query_id for g in got} == set(range(0, 600, 20))
    assert forest.nearest(df.limit(0)).count() == 0 and forest.nearest(df).count() == len(got)  # also when no column is wanted


def test_warc(spark, tmp_path):
    long = "<p>" + "WARC/1.1\r\nx: é " * 20
    p = spark.createDataFrame([(5, "u\r\nv", long), (3, "u", long), (9, None, None), (7, "u", "short"), (8, "u", "short"), (None, "w", long)], "page_id long, url string, html string")
    warc.written(p, str(tmp_path / "a"))
    recs = warc.read(spark, str(tmp_path / "a")).cache()
    assert Counter(r.record_type for r in recs.collect()) == {"response": 4, "revisit": 2, "request": 6, "metadata": 6}
    assert {(r.fields["WARC-Refers-To-Target-URI"], r.payload_digest) for r in recs.where("record_type = 'revisit'").collect()} == {("u", "sha256:" + hashlib.sha256(long.encode()).hexdigest())}
    marks = "WARC/1." * 200_000  # a payload of marks alone is read in linear time
    warc.written(spark.createDataFrame([(1, "u", marks)], "page_id long, url string, html string"), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).where("record_type = 'response'").first().payload == marks.encode()
    warc.written(p.limit(0), str(tmp_path / "c"))
    assert warc.read(spark, str(tmp_path / "c")).count() == 0
    recs = recs.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha256", F.sha2("payload", 256))
    caps = warc.assembled(recs)
    assert all(len(c.requests) == len(c.metadata) == 1 for c in caps.collect())
    n, d = len(long.encode()), hashlib.sha256(long.encode()).hexdigest()
    got = {r.page_id: tuple(r)[1:] for r in warc.resolved(caps).collect()}
    assert got[3] == (n, d, "response", None) and got[5] == got[None] == (n, d, "revisit", 3)
    assert got[9][0] == 0 and got[7][2] == got[8][2] == "response"


def test_language(spark, empty):
    r = random.Random(0)
    v = {"en": "the and of to in is that with this".split(), "de": "der die und ist ein nicht mit auf".split()}
    rows = [(i, " ".join(r.choice(v[l]) for _ in range(30)), l, l + "1.example." + l, 0) for i in range(60) for l in v]
    rows += [(900, "der die und ist nicht", None, None, 0), (901, "", "en", "en1.example.en", 0), (902, None, "de", "x", 0), (903, "12 + 3", "en", "x", 0), rows[0]]
    d = spark.createDataFrame(rows, DOCS)
    out = language.identified(clash(d), ["doc_id", "lang"]).collect()
    assert all(x.language == x.lang and x.kept for x in out if x.doc_id < 900)
    by = {x.doc_id: x for x in out}
    assert by[900].language == "de" and not by[901].kept and not by[902].kept and not by[903].kept and len(out) == len(rows)
    assert language.identified(empty, ["doc_id"]).count() == 0


def posteriors(rows, model):
    """Brute force: {row number: posterior by language} for rows (text, declared, host)."""
    k, w = len(model.languages), language.PRIOR_WEIGHT
    ll = [model(t) for t, _, _ in rows]
    p = [None if x is None else np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in ll]
    total = sum((x for x in p if x is not None), np.zeros(k)) + 1
    add = lambda key: {v: sum((x for x, r in zip(p, rows) if x is not None and key(r) == v), np.zeros(k)) for v in {key(r) for r in rows}}
    domain = lambda h: None if h is None else ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1] if h is not None and "." in h else None
    hosts, domains, declared, suffixes = add(lambda r: r[2]), add(lambda r: domain(r[2])), add(lambda r: r[1]), add(lambda r: suffix(r[2]))
    out = {}
    for i, (_, d, h) in enumerate(rows):
        if p[i] is None:
            continue
        over = total / total.sum()
        dom = (domains[domain(h)] + over * w) / (domains[domain(h)].sum() + w)
        score = ll[i] + (np.log(over) if h is None else np.log((hosts[h] + dom * w) / (hosts[h].sum() + w)))
        for table, key in ((declared, d), (suffixes, suffix(h))):
            if key is not None:
                score = score + np.log((table[key] + 0.5) / (total + w))
        e = np.exp(score - score.max())
        out[i] = e / e.sum()
    return out


def language_pages(spark):
    r = random.Random(4)
    v = {"en": "the and of to in is that with this".split(), "de": "der die und ist ein nicht mit auf".split()}
    say = lambda l, n=30: " ".join(r.choice(v[l]) for _ in range(n))
    top = {"en": "uk", "de": "at"}
    rows = [(i * 2 + k, f"http://www{i % 3}.{l}site{i % 2}.{top[l]}/p?q=1", f'<!DOCTYPE html><html class=x lang="{l}-XX"><body><script>var der = 1;</script><p>{say(l)}</p></body></html>') for i in range(40) for k, l in enumerate(v)]
    rows += [(100, None, "<p>der die und ist nicht</p>"), (101, None, "<html lang=de><p>xyzzy qqq</p>"), (102, "https://www0.desite0.at/", "<p>xyzzy qqq</p>"), (103, "https://new.example.at/", "<p>xyzzy qqq</p>"), (104, "https://www9.desite0.at/", "<p>xyzzy qqq</p>"), (105, "u", None)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_each_evidence_counts_on_pages(spark):
    rows, pages = language_pages(spark)
    out = {x.page_id: x for x in language.identified_pages(pages).collect()}
    assert len(out) == len(rows) and [out[i].declared for i in (0, 1, 100, 101)] == ["en", "de", None, "de"]
    assert out[0].host == "www0.ensite0.uk" and out[102].host == "www0.desite0.at" and out[100].host is None
    assert all(out[i].language == ("en", "de")[i % 2] for i in range(80)) and not out[105].kept
    # the text alone (100), with no known word: the markup alone (101), the host (102), the suffix alone (103), the domain and suffix (104)
    assert [out[i].language for i in (100, 101, 102, 103, 104)] == ["de"] * 5
    for i, plain in ((101, "<p>xyzzy qqq</p>"), (102, None), (103, None), (104, None)):  # the same pages without it
        bare = [(p, None if p == i and plain is None else u, plain if p == i and plain else h) for p, u, h in rows]
        got = {x.page_id: x for x in language.identified_pages(spark.createDataFrame(bare, pages.schema)).collect()}
        assert got[i].probability < out[i].probability
    assert language.identified_pages(pages.limit(0)).count() == 0


def test_language_posteriors(spark):
    rows, pages = language_pages(spark)
    body = [(p, language_text(h), d, u) for p, u, h, d in ((p, u, h, {0: "en", 1: "de"}[p % 2] if p < 100 else None) for p, u, h in rows)]
    d = spark.createDataFrame(body, "doc_id long, text string, lang string, url string")
    model = language.fitted(d)
    got = {x.doc_id: x for x in language.identified(d, ["doc_id"], address="url").collect()}
    host = lambda u: None if u is None else u.split("//")[-1].split("/")[0].lower()
    want = posteriors([(t, l, host(u)) for _, t, l, u in body], model)
    assert want.keys() == {i for i, b in enumerate(body) if got[b[0]].probability > 0}
    for i, p in want.items():
        x = got[body[i][0]]
        assert abs(x.probability - p.max()) < 1e-6 and (p.max() < 0.5 or x.language == model.languages[p.argmax()])


def language_text(html):
    import re

    return None if html is None else re.sub(r"(?s)<[^>]*>", " ", re.sub(r"(?is)<script.*?</script>", " ", html))


def test_rare_languages_have_a_sample(spark):
    rows = [(i, f"the and of to {i}", "en") for i in range(3000)] + [(i, "kaksi yksi kolme", "fi") for i in range(3000, 3004)]
    assert language.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100).languages == ["en", "fi"]


def test_gradients():
    net = toxicity.Network(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x = np.vstack([np.zeros(2 * toxicity.DIM), r.standard_normal((6, 2 * toxicity.DIM))])
    at, y = np.array([[1, 2, 3, 0], [4, 5, 6, 2]]), np.array([1.0, 0.0])
    g, dx = net.backward(x, at, y)

    def loss():
        s = toxicity.sigmoid(net.forward(x, at))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k in ("wf", "ub", "cf", "att", "vec", "out"):
        i = tuple(0 for _ in net.p[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-4
        up = loss()
        net.p[k][i] = old - 1e-4
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / 2e-4 - g[k][i]) < 1e-3


def test_toxicity(spark, empty):
    r = random.Random(3)
    base = texts(300, 5)
    rows = [(i, t.replace(" ", f" zork{r.choice('abc')}a ", 2) if i % 3 == 0 else t, "en", "s", 0) for i, t in enumerate(base)]
    d = spark.createDataFrame(rows + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "zorka zorkba", "en", "s", 0), rows[0]], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0 and " " in base[i])) for i in range(300)], "doc_id long, toxic int")
    out = toxicity.scored(d, toxicity.fitted(d, labels)).collect()
    assert len(out) == 304 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out)
    held = [x for x in out if x.held_out and x.doc_id is not None and x.doc_id < 300]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out if x.doc_id is not None)
    assert sum(x.predicted == int(x.doc_id % 3 == 0) for x in held) / len(held) > 0.9
    assert toxicity.scored(d, None).agg(F.max("score")).first()[0] == 0 and toxicity.scored(empty, None).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline as c

    at = docs
    for name, stage in c.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, "").collect(), DOCS)
        assert at.columns == docs.columns, name
    assert c.STAGES[-1][1](spark, at, "").count() >= at.count() > 0


def test_pipeline_run(spark, docs, empty, tmp_path):
    import corpus_pipeline as c

    clash(docs).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    out = c.run(spark, str(tmp_path / "a")).collect()
    at = clash(docs)
    for _, work in c.STAGES[:-1]:
        rows = work(spark, at, "").collect()
        assert set(at.columns) == set(clash(docs).columns)
        at = spark.createDataFrame(rows, at.schema)
    assert {r.doc_id for r in out} == {r.doc_id for r in rows} and len(out) >= len(rows)
    # what stays: one text of each set, no line twice
    kept = {r.doc_id for r in out}
    assert {3, 5} & kept and not {60, 62} <= kept and {63, 64, 65}.isdisjoint(kept)
    empty.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert c.run(spark, str(tmp_path / "b")).count() == 0


def test_toxicity_fit_is_the_same_in_any_order(spark):
    r = random.Random(3)
    rows = [(i % 40, t.replace(" ", " zork ", 2) if i % 2 else t, "en", "s", 0) for i, t in enumerate(texts(120, 7))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    one, two = (toxicity.fitted(spark.createDataFrame(x, DOCS), labels) for x in (rows, rows[::-1]))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)
    # scores by brute force: the greatest over all windows, each scored alone
    d = spark.createDataFrame(rows[:30], DOCS)
    for x, (_, t, *_) in zip(sorted(toxicity.scored(d, one).collect(), key=lambda x: x.doc_id), sorted(rows[:30])):
        assert abs(x.score - toxicity.Scorer(one)([t])[0]) < 1e-6


def near_kept(rows, shingle=5):
    """Brute force over (doc_id, text): the smallest doc_id of each component of a Jaccard similarity of 0.8 on shingle sets."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            same = len(sets[i] & sets[j])
            if i < j and (sets[i] == sets[j] or same and same * 5 >= (len(sets[i]) + len(sets[j]) - same) * 4):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted({top(i) for i in sets})


def edited_copies(seed=11):
    """Texts with copies in which 1 to 8 words of 150 are others: similarities of about 0.55 to 0.95, and chains of them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(25):
        w = [word() for _ in range(150)]
        out.append(" ".join(w))
        for changes in (1, 2, 3, 4, 8):
            x = list(w)
            for k in r.sample(range(150), changes):
                x[k] = word()
            out.append(" ".join(x))
            w = x if r.random() < 0.3 else w
    r.shuffle(out)
    return out + ["", "   ", "solo", "Solo", "a b c d e f g h", "a b c d e f g h i"]


def test_simhash_stage_reaches_jaccard_08(spark):
    import corpus_pipeline as c

    rows = list(enumerate(edited_copies()))
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = c.simhash_dedup(spark, d, "")
    assert kept.columns == d.columns
    assert sorted(x.doc_id for x in kept.collect()) == near_kept(rows)
