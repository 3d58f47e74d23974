"""Token budgets of sentences and of turns, and an index of vectors that embeds only what has changed."""

import random

import pytest

from graphloom.functions.sentences import sentences
from graphloom.operators import embeddings as Y, tokens as K


def tokenizers():
    """One that has an id for each four letters of a word and joins short neighbours, so that sizes don't add up; and one of bytes. Made here so that tasks need no module of the tests."""

    def words():
        return lambda texts: [[len(w[i : i + 4]) for w in x.replace("a b", "ab").split() for i in range(0, len(w), 4)] for x in texts]

    def ids():
        return lambda texts: [list(x.encode()) for x in texts]

    return words, ids


words, ids = tokenizers()


def texts(n, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abc") for _ in range(r.choice([1, 1, 2, 5, 9])))
    return [" ".join(word() + r.choice(["", "", "", ".", "!"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("budget, overlap", [(12, 0), (12, 4), (1, 0), (500, 100)])
def test_chunks(spark, budget, overlap):
    docs = [(i, t) for i, t in enumerate([*texts(40), "x" * 200, None, "  "])]
    d = spark.createDataFrame(docs, "id long, t string").repartition(3)
    got = {}
    for r in K.token_chunks(d, "id", "t", words, budget, overlap, ".!").orderBy("id", "pos").collect():
        assert r.tokens == len(words()([r.chunk])[0]) and (r.tokens <= budget or len(r.chunk) == 1)
        assert r.pos == len(got.setdefault(r.id, []))
        got[r.id].append(r.chunk)
    for i, t in docs:
        own = got.get(i, [])
        assert bool(own) == bool(sentences(t, ".!"))
        if not overlap:
            assert "".join(own).replace(" ", "") == "".join(sentences(t, ".!")).replace(" ", "")
            if budget == 12:  # no two neighbours would fit in one
                assert all(len(words()([a + " " + s])[0]) > budget for a, b in zip(own, own[1:]) if (s := sentences(b, ".!")[0]) in sentences(t, ".!"))


def test_overlap():
    parts = [f"{c}{c}{c}." for c in "abcdef"]
    encode = lambda xs: [x.split() for x in xs]
    assert [x for x, _ in K.packed(parts, [1] * 6, encode, 3, 1)] == ["aaa. bbb. ccc.", "ccc. ddd. eee.", "eee. fff."]
    assert [x for x, _ in K.packed(parts, [1] * 6, encode, 3)] == ["aaa. bbb. ccc.", "ddd. eee. fff."]


def masked(turns, cutoff, least, bos, eos, on_prompt, one_eos):
    """The rule, token by token."""
    out = []
    for i, (q, a) in enumerate(turns):
        s, t = ([bos] if bos is not None and i == 0 else []) + list((q or "").encode()), list((a or "").encode()) + ([eos] if eos is not None and not one_eos else [])
        most = min(cutoff, max(int(cutoff * (len(t) / (len(s) + len(t)))) if s or t else 0, least))
        for k, x in enumerate(s[: cutoff - most]):
            out.append((x, x if on_prompt else eos if one_eos and i and k == 0 and eos is not None else -100))
        out += [(x, x) for x in t[:most]]
    return (out + [(eos, eos)] * (one_eos and eos is not None))[:cutoff]


@pytest.mark.parametrize("bos, eos, on_prompt, one_eos", [(None, None, False, False), (1, 2, False, False), (1, 2, False, True), (None, 2, True, True)])
def test_turns(spark, bos, eos, on_prompt, one_eos):
    r = random.Random(1)
    text = lambda: r.choice(["", None, *("".join(r.choice("abé") for _ in range(r.randint(1, 30))) for _ in range(6))])
    rows = [(i, [(text(), text()) for _ in range(r.randint(0, 4))]) for i in range(80)] + [(99, None)]
    d = spark.createDataFrame(rows, "id long, turns array<struct<query:string,answer:string>>")
    got = {x.id: list(zip(x.input_ids, x.labels, strict=True)) for x in K.supervised_turns(d, "turns", ids, 40, 6, bos, eos, on_prompt, one_eos).collect()}
    assert got == {i: masked(t, 40, 6, bos, eos, on_prompt, one_eos) for i, t in rows if t and t[-1][0] and t[-1][1]}


def test_index_embeds_what_has_changed(spark, tmp_path):
    path, seen = str(tmp_path / "index"), str(tmp_path / "seen")

    def model():
        def run(xs):
            with open(seen, "a") as f:
                f.writelines(x + "\n" for x in xs)
            return [[len(x), x.count("a")] for x in xs]

        return run

    def asked():
        try:
            with open(seen) as f:
                out = sorted(f.read().split("\n")[:-1])
        except FileNotFoundError:
            return []
        open(seen, "w").close()
        return out

    def now(rows):
        d = spark.createDataFrame(rows, "id long, t string")
        return {r.id: list(r.embedding) for r in Y.refreshed(spark, path, d, "id", "t", model, 2).collect()}

    assert now([(1, "aa"), (2, "b"), (3, None), (None, "x")]) == {1: [2, 2], 2: [1, 0], 3: [0, 0]} and asked() == ["", "aa", "b"]
    assert now([(1, "aa"), (2, "b"), (3, None)]) == {1: [2, 2], 2: [1, 0], 3: [0, 0]} and asked() == [] and Y.generations(spark, path) == 1
    assert now([(1, "ab"), (2, "b"), (4, "new")]) == {1: [2, 1], 2: [1, 0], 4: [3, 0]} and asked() == ["ab", "new"]
    assert now([(3, "b"), (2, "b"), (2, "b")]) == {2: [1, 0], 3: [1, 0]} and asked() == ["b"] and Y.generations(spark, path) == 3
    Y.compacted(spark, path, str(tmp_path / "one"))
    assert {r.id for r in Y.stored(spark, str(tmp_path / "one")).collect()} == {2, 3} and Y.stored(spark, str(tmp_path / "none")) is None


def test_vectors_of_another_length(spark):
    with pytest.raises(Exception, match="not vectors of 3"):
        Y.embedded(spark.createDataFrame([(1, "a")], "id long, t string"), "id", "t", lambda: lambda xs: [[1.0, 2.0] for _ in xs], 3).collect()


def test_work_grows_with_the_text():
    """Long sentences are cut, and chunks of many short ones found, by work that grows no faster than the text, with the chunks of trying each size in turn."""

    def plainly(parts, sizes, encode, budget, overlap):
        held, out, start, new = [(p, n) for p, n in zip(parts, sizes)], [], 0, 0
        while new < len(held):
            end, size = new + 1, sum(n for _, n in held[start : new + 1])
            while end < len(held) and size + held[end][1] <= budget:
                size, end = size + held[end][1], end + 1
            while len(encode([" ".join(x for x, _ in held[start:end])])[0]) > budget and end - start > 1:
                start, end = (start + 1, end) if start < new else (start, end - 1)
            out.append(" ".join(x for x, _ in held[start:end]))
            new = start = end
            kept = 0
            while overlap and start > 0 and (kept := kept + held[start - 1][1]) <= overlap:
                start -= 1
        return out

    for overlap in (0, 5, 9):
        parts = [random.Random(i).choice(["a.", "bb.", "ccc.", "!"]) for i in range(300)]
        own = [len(x) for x in ids()(parts)]
        assert [x for x, _ in K.packed(parts, own, ids(), 20, overlap)] == plainly(parts, own, ids(), 20, overlap)

    def work(text_parts, budget):
        seen = [0]

        def encode(xs):
            seen[0] += sum(map(len, xs))
            return ids()(xs)

        out = K.packed(text_parts, [len(x) for x in text_parts], encode, budget)
        return seen[0], out

    (a, one), (b, two) = work(["xyz " * 2000], 50), work(["xyz " * 20000], 50)
    assert b < 11 * a and all(n <= 50 for _, n in two) and "".join(x for x, _ in two).replace(" ", "") == "xyz" * 20000
    assert work(["!"] * 4000, 1000)[0] < 30 * 8000


def test_texts_are_encoded_in_bounded_groups(spark, tmp_path):
    """A batch of many texts, or a text of many sentences, isn't encoded at once, nor is a giant sentence as a whole."""
    seen = str(tmp_path / "seen")

    def load():
        def encode(xs):
            with open(seen, "a") as f:
                f.write(f"{sum(map(len, xs))}\n")
            return [[1] * len(x) for x in xs]

        return encode

    docs = [(i, "abcd. " * 1000) for i in range(600)] + [(None, "abcd. " * 400_000), (1 << 60, "xyz " * 900_000), (7, None)]
    d = spark.createDataFrame(docs, "id long, t string").coalesce(1)
    got = K.token_chunks(d, "id", "t", load, 1000, 0, ".").collect()
    with open(seen) as f:
        assert max(map(int, f)) < 2_200_000
    whole = {}
    for r in got:
        whole[r.id] = whole.get(r.id, 0) + len(r.chunk.replace(" ", ""))
    assert whole[None] == 5 * 400_000 and whole[1 << 60] == 3 * 900_000 and whole[5] == 5000 and max(r.tokens for r in got) <= 1000
    assert len(whole) == 602


def test_ids_by_words():
    """The ids of words with the space before them, also once they are kept, are those of the vocabulary for the whole text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from graphloom.plans.text_queries import bpe_ids

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(2)
    signs = ["a", "b", " ", " ", " the", "  ", "\n", "\t", ".", "!", "é", "日本", "́", "\xa0", "　", "\x1c", "\x85", "\0", "12", "'s", "<|endoftext|>", "😀", "-", "x" * 50]
    texts = ["", *("".join(r.choice(signs) for _ in range(r.randint(1, 30))) for _ in range(3000))]
    own = K.by_words(bpe_ids(), 50)
    for encode in (bpe_ids(), own):
        for xs in (texts, texts[:100], texts[:100]):
            assert [list(x) for x in encode(xs)] == [x.ids for x in t.encode_batch(xs, add_special_tokens=False)]
    long = "a" + " " * 3_000_000 + "b"
    assert bpe_ids()([long]) == [t.encode(long, add_special_tokens=False).ids]
    asked = []
    K.by_words(lambda ws: asked.extend(ws) or [[1] for _ in ws])(["a b a b a", "b a  c", " d"])
    assert sorted(asked) == [" a", " a  c", " b", " d", "a", "b"]
