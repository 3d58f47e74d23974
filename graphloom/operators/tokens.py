"""Token budgets: sentences packed to chunks, and turns to training rows with masked labels. The tokenizer is the caller's.

``load`` is called once a task and gives a function from a list of texts to a list of lists of ids. Texts are encoded together as far as their characters are bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from graphloom.functions.sentences import ENDS, sentences
from graphloom.functions.slices import CHARACTERS, slices

Encode = Callable[[list[str]], list[list[int]]]
#: The label of a token that isn't trained on.
IGNORED = -100
#: A single space between other characters.
SPACE = re.compile(r"(?<=\S) (?=\S)")


def words(text: str) -> list[str]:
    """The text cut before single spaces between other characters."""
    if text.isprintable() and "  " not in text and text == text.strip(" "):  # no other white space
        return text.replace(" ", "\0 ").split("\0")
    return SPACE.sub("\0 ", text).split("\0") if "\0" not in text else [text]


def by_words(encode: Encode, most: int = 200_000, longest: int = 48) -> Encode:
    """``encode`` by ``words``, of which the ids of about ``most`` with at most ``longest`` characters are kept.

    Only for tokenizers of which no token spans a place where words are cut, as those of byte-level vocabularies that take words with the space before.
    """
    kept: dict[str, tuple[int, ...]] = {}  # tuples of numbers are not searched for garbage

    def run(texts: list[str]) -> list[list[int]]:
        cut = [words(x) for x in texts]
        new = list({w for ws in cut for w in ws if w not in kept})
        kept.update(zip(new, map(tuple, encode(new))))
        out = [list(chain.from_iterable(map(kept.__getitem__, ws))) for ws in cut]
        if len(kept) > most:
            kept.clear()
        for w in new:
            if len(w) > longest:
                kept.pop(w, None)
        return out

    return run


def longest_prefix(text: str, encode: Encode, budget: int) -> int:
    """A number of characters, one at least, that fits the budget: up to the last space of the largest part found by bisection that leaves no less than half of it, else all of it.

    Parts as long as a beginning of more than twice the budget don't fit, and aren't encoded.
    """
    low, high = 1, len(text)
    beyond = len(beginning(text, encode, budget)[0])
    while low < high:
        mid = (low + high + 1) // 2
        fits = (mid < beyond or beyond == len(text)) and len(encode([text[:mid]])[0]) <= budget
        low, high = (mid, high) if fits else (low, mid - 1)
    space = text.rfind(" ", 0, low)
    return space + 1 if low < len(text) and space >= low // 2 else low


def beginning(text: str, encode: Encode, budget: int) -> tuple[str, int]:
    """A beginning of the text that has more than twice the budget of tokens, and their number; all of the text where it has no more. Work is bounded by the beginning's length."""
    n = max(4 * budget, 64)
    while n < len(text):
        size = len(encode([text[:n]])[0])
        if size > 2 * budget:
            return text[:n], size
        n *= 2
    return text, len(encode([text])[0]) if text else 0


def pieces(parts: list[str], sizes: list[int], encode: Encode, budget: int) -> list[tuple[str, int]]:
    """Sentences with their numbers of tokens; those beyond the budget are cut."""
    out = []
    for x, n in zip(parts, sizes):
        while n > budget and len(x) > 1:
            k = longest_prefix(x, encode, budget)
            out.append((x[:k].rstrip() or x[:k], len(encode([x[:k].rstrip() or x[:k]])[0])))
            x = x[k:].lstrip()
            n = beginning(x, encode, budget)[1]
        if x:
            out.append((x, n))
    return out


def measured(parts: list[str], encode: Encode, budget: int) -> list[int]:
    """The sentences' numbers of tokens, encoded in groups of bounded characters; of one beyond those, the number that a ``beginning`` of it has."""
    out: list[int] = []
    for group in slices(pd.Series(parts, dtype=object), len):
        told = iter(encode([x for x in group if len(x) <= CHARACTERS]))
        out += [len(next(told)) if len(x) <= CHARACTERS else beginning(x, encode, budget)[1] for x in group]
    return out


def packed(parts: list[str], sizes: list[int], encode: Encode, budget: int, overlap: int = 0, separator: str = " ") -> list[tuple[str, int]]:
    """Chunks (text, tokens) of consecutive sentences; as many as fit the budget, told by the tokens of the whole chunk.

    A chunk begins with the last sentences of the one before that have at most ``overlap`` tokens together, as far as they leave room for a new one.
    """
    held = pieces(parts, sizes, encode, budget)
    out: list[tuple[str, int]] = []
    start, new = 0, 0  # the chunk's first sentence, and the first that no chunk has
    while new < len(held):
        end, size = new + 1, sum(n for _, n in held[start : new + 1])
        while end < len(held) and size + held[end][1] <= budget:
            size += held[end][1]
            end += 1
        spare, most = new - start, end - start - 1

        def told(k: int) -> tuple[str, int]:
            """The chunk without ``k`` sentences: those of the chunk before go first, then the last ones."""
            text = separator.join(x for x, _ in held[start + min(k, spare) : end - max(k - spare, 0)])  # noqa: B023
            return text, len(encode([text])[0])

        # what the sentences have together is not what they have apart: the least number of them that must go, by steps that double and then halve
        low, high, made = -1, 0, told(0)
        while made[1] > budget and high < most:
            low, high = high, min(2 * high + 1, most)
            made = told(high)
        while high - low > 1:
            mid = (low + high) // 2
            if (tried := told(mid))[1] <= budget or mid == most:
                high, made = mid, tried
            else:
                low = mid
        start, end = start + min(high, spare), end - max(high - spare, 0)
        out.append(made)
        new = start = end
        kept = 0
        while overlap and start > 0 and (kept := kept + held[start - 1][1]) <= overlap:
            start -= 1
    return out


def token_chunks(docs: DataFrame, key: str, text: str, load: Callable[[], Encode], budget: int = 1024, overlap: int = 0, ends: str = ENDS) -> DataFrame:
    """(key, pos, chunk, tokens): the sentences of each text in chunks of at most ``budget`` tokens, numbered from 0.

    A sentence beyond the budget is cut, at a space if there is one in the last half of what fits. Only a single character of more tokens than the budget exceeds it. Null and blank texts have no chunk.
    """
    schema = StructType([docs.schema[key], StructField("pos", IntegerType()), StructField("chunk", StringType()), StructField("tokens", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for b in batches:
            keys, column = b.column(0), b.column(1)
            # a batch's sentences, ids and chunks together would take many times its size
            for part in slices(pd.Series(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), dtype=object), int):
                start = part.index[0] if len(part) else 0
                cut = [sentences(x, ends) for x in column.slice(start, len(part)).to_pylist()]
                sizes = iter(measured([s for c in cut for s in c], encode, budget))
                out = [(start + j, i, *x) for j, c in enumerate(cut) for i, x in enumerate(packed(c, [next(sizes) for _ in c], encode, budget, overlap))]
                at, pos, chunk, tokens = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(chunk, column.type), pa.array(tokens, pa.int32())], [f.name for f in schema])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def budgets(source: int, target: int, cutoff: int, least_target: int) -> tuple[int, int]:
    """The most tokens of a turn's source and target: ``cutoff`` in proportion to their lengths, the target ``least_target`` at least."""
    t = min(cutoff, max(cutoff * target // (source + target) if source + target else 0, least_target))
    return cutoff - t, t


def trained(turns: list[tuple[list[int], list[int]]], cutoff: int, least_target: int, eos: int | None, on_prompt: bool = False, one_eos: bool = False) -> tuple[list[int], list[int]]:
    """(ids, labels) of a dialogue's encoded turns: each cut to its budgets, sources masked, the whole cut to ``cutoff``.

    Targets end with ``eos``; with ``one_eos`` only the dialogue does, and a later turn's first source token has ``eos`` for its label.
    """
    ids: list[int] = []
    labels: list[int] = []
    for i, (source, target) in enumerate(turns):
        target = target if one_eos or eos is None else [*target, eos]
        s, t = budgets(len(source), len(target), cutoff, least_target)
        source, target = source[:s], target[:t]
        mask = source if on_prompt else [IGNORED] * len(source)
        if one_eos and i and mask and not on_prompt and eos is not None:
            mask = [eos, *mask[1:]]
        ids += source + target
        labels += mask + target
    if one_eos and eos is not None:
        ids, labels = [*ids, eos], [*labels, eos]
    return ids[:cutoff], labels[:cutoff]


def supervised_turns(rows: DataFrame, turns: str, load: Callable[[], Encode], cutoff: int = 1024, least_target: int = 1, bos: int | None = None, eos: int | None = None, on_prompt: bool = False, one_eos: bool = False) -> DataFrame:
    """``rows`` with input_ids and labels of ``turns`` (an array of structs query, answer, as they are rendered), in that order.

    Rows without turns, and those whose last query or answer is null or empty, go. Other nulls are empty. The first source begins with ``bos``. The attention mask is 1 for every id, so that it isn't kept.
    """
    keep = [c for c in rows.columns if c not in ("input_ids", "labels")]
    schema = StructType([*rows.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, StructField("input_ids", ArrayType(LongType())), StructField("labels", ArrayType(LongType()))])
    last = F.get(F.col(turns), F.size(turns) - 1)
    some = rows.where((F.size(turns) > 0) & (F.coalesce(last["query"], F.lit("")) != "") & (F.coalesce(last["answer"], F.lit("")) != ""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for b in batches:
            told = [[(x["query"] or "", x["answer"] or "") for x in t] for t in b[turns]]
            ids = iter(encode([y for t in told for x in t for y in x]))
            out = []
            for t in told:
                coded = [(list(next(ids)), list(next(ids))) for _ in t]
                if bos is not None:
                    coded[0] = ([bos, *coded[0][0]], coded[0][1])
                out.append(trained(coded, cutoff, least_target, eos, on_prompt, one_eos))
            yield b.assign(input_ids=[x for x, _ in out], labels=[y for _, y in out])

    return some.select(*[F.col(f"`{c}`") for c in keep]).mapInPandas(run, schema)
