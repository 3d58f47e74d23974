"""Fill-in-the-middle: texts cut at two token boundaries and put together anew, in one of two orders.

Tokens are runs of letters A-Z and a-z, and every other character. A batch of texts is one packed bitvector with a bit for each
byte that begins a token, and one for each byte that begins a character; a directory holds the number of set bits before each
block of 512. Ranks at the ends of a text give its number of tokens, a rank and a select turn a number of tokens into a byte,
and ranks of characters its length. Texts are cut at those bytes; no token is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import missing_names, small_batches, table
from graphloom.llm.shingles import groups, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that stay plain, and of the others that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: Bytes whose bits are made at once: a multiple of a block.
STEP = 1 << 20


class Bits:
    """A packed bitvector with a directory of blocks of WORDS longs: rank and select without a scan."""

    WORDS = 8

    def __init__(self, packed: np.ndarray):
        """``packed``: bytes of eight bits, the first bit lowest."""
        block = 8 * self.WORDS
        held = np.zeros(-(-len(packed) // block) * block + block, np.uint8)  # a spare block, so that every rank has one
        held[: len(packed)] = packed
        self.words = held.view("<u8")
        self.ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.ones.reshape(-1, self.WORDS).sum(axis=1))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The set bits before each place."""
        word = at >> 6
        block = word // self.WORDS
        own = np.arange(self.WORDS)[None, :] < (word % self.WORDS)[:, None]
        whole = (self.ones.reshape(-1, self.WORDS)[block] * own).sum(axis=1)
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + whole + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the set bit that has k set bits before it; k is below their number."""
        block = np.searchsorted(self.before, k, "right") - 1
        upto = np.cumsum(self.ones.reshape(-1, self.WORDS)[block], axis=1)
        left = k - self.before[block]
        word = (upto <= left[:, None]).sum(axis=1)
        left = left - np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        value = self.words[block * self.WORDS + word]
        place = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the half of the word in which the bit lies
            low = np.bitwise_count(value & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left = np.where(up, left - low, left)
            value = np.where(up, value >> np.uint64(half), value)
            place += np.where(up, half, 0)
        return (block * self.WORDS + word) * 64 + place


def boundaries(b: np.ndarray, start: np.ndarray) -> tuple[Bits, Bits]:
    """The bytes of ``b`` that begin a token, and those that begin a character; texts begin at ``start``."""
    tokens, chars = np.zeros(-(-len(b) // 8), np.uint8), np.zeros(-(-len(b) // 8), np.uint8)
    for i in range(0, len(b), STEP):
        part = b[i : i + STEP]
        lead = (part & 0xC0) != 0x80
        letter = LETTER[part]
        first = lead.copy()
        first[1:] &= ~(letter[1:] & letter[:-1])
        if i and letter[0] and LETTER[b[i - 1]]:
            first[0] = False
        at = start[(start >= i) & (start < i + len(part))] - i
        first[at] = True
        tokens[i // 8 : i // 8 + -(-len(part) // 8)] = np.packbits(first, bitorder="little")
        chars[i // 8 : i // 8 + -(-len(part) // 8)] = np.packbits(lead, bitorder="little")
    return Bits(tokens), Bits(chars)


def cut(column: pa.Array, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number of tokens n, the bytes after min and max of ``one`` % (n + 1) and ``two`` % (n + 1) tokens, and the characters of prefix and middle."""
    b, at = text_bytes(column)
    tokens, chars = boundaries(b, at[:-1][np.diff(at) > 0])
    first = tokens.rank(at)
    n = np.diff(first)
    x, y = one % (n + 1), two % (n + 1)

    def byte(u: np.ndarray) -> np.ndarray:
        out = at[1:].copy()
        some = np.flatnonzero(u < n)
        out[some] = tokens.select(first[:-1][some] + u[some])
        return out

    p, m = byte(np.minimum(x, y)), byte(np.maximum(x, y))
    c = [chars.rank(z) for z in (at[:-1], p, m)]
    return n, p - at[:-1], m - at[:-1], c[1] - c[0], c[2] - c[1]


def drawn(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32, from the first 32 digits of the SHA-256 of the seed, a colon and the key; a null key counts as empty."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def filled(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and ``fim``, the text in its new form.

    The form is plain for empty or null texts, for those that hold one of the marks, and for a tenth of the rest by their key; else the
    suffix comes first (spm) in a fifth, and the prefix (psm) in others. prefix_chars and middle_chars are null
    where it is plain. A null text is an empty one, a null key counts as empty; rows that share a key are cut by the same numbers. Of columns that bear
    the added names, the added ones stay. Empty input, empty result.
    """
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "fim")
    t, h1, h2, p, m = missing_names(docs, "fim_text", "fim_1", "fim_2", "fim_p", "fim_m")
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h = drawn(F.col(f"`{key}`"), seed)
    marked = (own == "") | own.contains(PREFIX) | own.contains(SUFFIX) | own.contains(MIDDLE)
    form = F.when(marked | (h[2] % 100 >= 100 - PLAIN), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`") for c in names], form.alias("form"), own.alias(t), h[0].alias(h1), h[1].alias(h2))
    k = len(names)
    marks = {x: pa.scalar(x, pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE)}

    def run(batches):
        for batch in batches:
            one, two = (batch.column(i).to_numpy(zero_copy_only=False) for i in (k + 2, k + 3))
            for i, part in groups(batch.column(k + 1)):
                j = i + len(part)
                n, p_end, m_end, p_chars, m_chars = cut(part, one[i:j], two[i:j])
                form = batch.column(k).slice(i, j - i)
                plain = np.asarray(form.to_numpy(zero_copy_only=False) == "plain")
                raw = part.cast(pa.large_string()).cast(pa.large_binary())
                prefix, middle, suffix = sliced(raw, np.zeros_like(p_end), p_end), sliced(raw, p_end, m_end), sliced(raw, m_end, None)
                p_first = pa.compute.binary_join_element_wise(marks[PREFIX], prefix, marks[SUFFIX], suffix, marks[MIDDLE], middle, pa.scalar(b"", pa.large_binary()))
                s_first = pa.compute.binary_join_element_wise(marks[SUFFIX], suffix, marks[PREFIX], prefix, marks[MIDDLE], middle, pa.scalar(b"", pa.large_binary()))
                out = pa.compute.case_when(pa.StructArray.from_arrays([pa.array(plain), pa.compute.equal(form, "spm")], names=["a", "b"]), raw, s_first, p_first)
                columns = [c.slice(i, j - i) for c in batch.columns[: k + 1]]
                chars = [pa.array(c.astype(np.int64), mask=plain) for c in (p_chars, m_chars)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), *chars, out.cast(pa.binary()).cast(pa.string())], names=[*batch.schema.names[: k + 1], "n", "prefix_chars", "middle_chars", "fim"])

    small_batches(docs.sparkSession)
    schema = rows.select(*[F.col(f"`{c}`") for c in names], "form", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"), F.lit("").alias("fim")).schema
    return rows.mapInArrow(run, schema)


def sliced(raw: pa.Array, start: np.ndarray, end: np.ndarray | None) -> pa.Array:
    """The bytes [start, end) of each value, without a step for each: the parts lie at their places in the values' own buffer."""
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    a, z = at[:-1] + start, at[1:] if end is None else at[:-1] + end
    size = np.concatenate([[0], np.cumsum(z - a)])
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.empty(0, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)  # parts of one batch don't overlap
    np.add.at(inside, a, 1)
    np.add.at(inside, z, -1)
    kept = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(kept)])


def restored(fim: Column, form: Column) -> Column:
    """The text that ``filled`` has put into ``form``: only the marks divide its parts, as no text that holds one is cut."""
    after = lambda x, mark: x.substr(F.locate(mark, x) + F.lit(len(mark)), F.length(x))
    upto = lambda x, mark: F.substring_index(x, mark, 1)
    middle = after(fim, MIDDLE)
    psm = F.concat(upto(fim.substr(F.lit(len(PREFIX) + 1), F.length(fim)), SUFFIX), middle, upto(after(fim, SUFFIX), MIDDLE))
    spm = F.concat(upto(after(fim, PREFIX), MIDDLE), middle, upto(fim.substr(F.lit(len(SUFFIX) + 1), F.length(fim)), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(fim)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("fim"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP12_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), d AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS k, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2,
    ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM h
), c AS (
  SELECT *, len(k) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS i, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), x AS (
  SELECT doc_id, t, n, form, array_to_string(k[1:i], '') AS p, array_to_string(k[i + 1:j], '') AS m, array_to_string(k[j + 1:], '') AS r FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || r || '<M>' || m ELSE '<S>' || r || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM x
"""
