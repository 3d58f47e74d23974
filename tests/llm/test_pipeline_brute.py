"""The whole pipeline on some two hundred documents against a plain version of each of its stages, one on what the one before keeps."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm import DOCS, near_kept, posteriors

import corpus_pipeline
from graphloom.llm import language, packing


def documents(seed=5):
    r = random.Random(seed)
    say = {"en": "the and of to in is that with this for was on are as".split(), "fi": "ja on se ei että oli hän mutta kun niin myös joka".split()}
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvy") for _ in range(r.randint(3, 8)))
    lines = {l: [" ".join(r.choice(v) if r.random() < 0.5 else word() for _ in range(r.randint(7, 16))) for _ in range(300)] for l, v in say.items()}
    shared = [" ".join(word() for _ in range(12)) for _ in range(6)]
    out = []
    for i in range(150):
        l = r.choice(list(say))
        own = r.sample(lines[l], r.randint(3, 8)) + ([r.choice(shared)] if r.random() < 0.3 else [])
        if r.random() < 0.2:
            x = own[0].split()
            x[r.randrange(len(x))] = word()
            own.append(" ".join(x))
        out.append("\n".join(own))
    for i in range(30):  # near copies of a document, with a word or two changed in each line
        x = [y.split() for y in out[i].split("\n")]
        for y in x:
            y[r.randrange(len(y))] = word()
        out.append("\n".join(map(" ".join, x)))
    for i in range(40, 55):  # the words of a document, broken into lines elsewhere, with a word changed
        x = out[i].split()
        x[r.randrange(len(x))] = word()
        out.append("\n".join(" ".join(x[k : k + 9]) for k in range(0, len(x), 9)))
    out += out[:6] + ["", None, "   ", "12345 67", shared[0], shared[0] + "\n" + shared[1], "the and of " * 400]
    rows = [(i, t, r.choice(["en", "fi", None]), None if i % 13 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(out)]
    r.shuffle(rows)
    return rows


def of_known_language(rows, model):
    host = lambda s: None if s is None else s.lower()
    p = posteriors([(t, l, host(s)) for _, t, l, s, _ in rows], model)
    return [x for i, x in enumerate(rows) if i in p and p[i].max() >= language.LEAST]


def without_lines(rows):
    seen, out = [], []
    for i, t, l, s, n in sorted(rows, key=lambda r: r[0]):
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            w = line.split()
            grams = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
            if w and any(5 * len(grams & x) >= 4 * len(grams | x) for x in seen):
                gone += 1
            else:
                kept.append(line)
            if w:
                seen.append(grams)
        text = "\n".join(kept) if gone else t
        if not gone or (text or "").strip():
            out.append((i, text, l, s, len(text)))
    return out


def targets(rows):
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").split())
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
    return want


def pieces(text, tok):
    ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
    cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_pipeline_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = documents()
    df = spark.createDataFrame(rows, DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    model = language.fitted(df)
    known = of_known_language(rows, model)
    cut = without_lines(known)
    ids = near_kept([(i, t) for i, t, *_ in cut])
    kept = {r[0]: r for r in cut if r[0] in set(ids)}
    assert len(known) < len(rows) and len(kept) < len(cut) < len(known)
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, df, "")
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in known)
    two = stages["line_dedup"](spark, one, "")
    assert sorted(map(repr, map(tuple, two.collect()))) == sorted(map(repr, cut))
    three = stages["simhash_dedup"](spark, two, "")
    assert sorted(map(repr, map(tuple, three.collect()))) == sorted(map(repr, kept.values()))

    tok = Tokenizer.from_file(packing.vocabulary()[0])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in out if r.piece == 0)
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    want, taken = targets(kept.values()), Counter()
    for i, n in copies.items():
        taken[kept[i][3]] += n * len((kept[i][1] or "").split())
    assert all(taken[s] == pytest.approx(want[s], rel=0.1, abs=120) for s in want)
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    assert got == Counter({(i, *p): n for i, n in copies.items() for p in pieces(kept[i][1], tok)})
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
