"""Best-fit packing of token sequences: bounded-space online best-fit.

Each input partition packs its own documents in one pass, so that nothing is
shuffled and a lost task is simply run again. Open bins are held in a bitset keyed by free space
(bit f set: some open bin has f tokens free); the best fit for a piece is the lowest
set bit at or above its length. When more than ``open_bins`` are open, the fullest closes.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import small_batches, table

LENGTH = 1024
OPEN_BINS = 4096
END_ID = 2
CACHED_UNITS = 200_000
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Bins:
    """Open bins by free space. ``place`` returns (bin number, offset)."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.open_bins = length, open_bins
        self.bits, self.at, self.n_open, self.made = 0, [[] for _ in range(length + 1)], 0, 0

    def _pop(self, free: int) -> int:
        b = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return b

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = self._pop(free)
        else:
            free, b = self.length, self.made
            self.made += 1
        left = free - n
        if left:  # a full bin is closed
            self.at[left].append(b)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:
                self._pop((self.bits & -self.bits).bit_length() - 1)
        return b, self.length - free


class Ids:
    """A text's token ids as little-endian uint32 bytes, equal to those of the vocabulary file in the ``tokenizers`` library.

    Texts are cut before single spaces between other characters, where no token of this
    byte-level vocabulary can span, and the ids of each unit are kept. A unit of
    Latin letters, digits and ASCII signs goes to the tiktoken form of the same
    vocabulary, whose splitting pattern agrees there; any other unit, and any with the special token's
    string, goes to ``tokenizers`` itself.
    """

    PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ſ]*")
    CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact, self.fast, self.kept = Tokenizer.from_file(json_path), None, {}
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.size = np.zeros(max(ranks.values()) + 1, np.int64)
            self.size[list(ranks.values())] = [len(b) for b in ranks]

    def _plain(self, s: str) -> bool:
        return self.fast is not None and (s.isascii() and s.isprintable() or self.PLAIN.fullmatch(s) is not None) and "<|" not in s

    def _unit(self, s: str) -> bytes:
        ids = self.fast(s) if self._plain(s) else self.exact.encode(s, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def _learned(self, units: list[str]) -> dict[str, bytes]:
        """The ids of each unit with the space before it. Plain units are encoded in one text, whose tokens end where units do."""
        plain = [u for u in units if self._plain(u)]
        out = {u: self._unit(" " + u) for u in units if not self._plain(u)} if len(plain) < len(units) else {}
        if plain:
            ids = np.asarray(self.fast(" " + " ".join(plain)), dtype="<u4")
            ends = np.cumsum([len(u.encode()) + 1 for u in plain])
            upto = 4 * (np.searchsorted(np.cumsum(self.size[ids]), ends) + 1)
            raw, at = ids.tobytes(), 0
            for u, end in zip(plain, upto.tolist()):
                out[u] = raw[at:end]
                at = end
        if len(self.kept) + len(out) > CACHED_UNITS:
            self.kept.clear()
        self.kept.update(out if max(map(len, units)) < 48 else {u: x for u, x in out.items() if len(u) < 48})
        return out

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        first, *units = self.CUT.split(text)
        ids = list(map(self.kept.get, units))
        if None in ids:
            new, some = {}, list(dict.fromkeys([u for u, x in zip(units, ids) if x is None]))
            for i in range(0, len(some), 4096):
                new.update(self._learned(some[i : i + 4096]))
            ids = [new[u] if x is None else x for u, x in zip(units, ids)]
        return self._unit(first) + b"".join(ids)


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path(f"{name}.json"), P.path(f"{name}.tiktoken"), P.PATTERN


def pack(docs: DataFrame, vocab: tuple | None = None, length: int = LENGTH, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """Packs doc_id, text of ``docs`` into sequences of at most ``length`` tokens; a row for each piece.

    A document is its ids and ``end_id``. One of more than ``length`` is cut into
    pieces of ``length``, the first of which takes the rest and may be shorter.
    Null and empty texts are the end id alone; null doc_ids stay null; repeated rows are packed
    each; other columns are ignored; an empty table gives no rows.
    """
    vocab = vocab or vocabulary()
    small_batches(docs.sparkSession)

    def run(batches):
        ids_of, bins, end = Ids(*vocab), Bins(length, open_bins), np.asarray([end_id], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py() or "") + end
                n = len(ids) // 4
                at, piece, size = 0, 0, (n - 1) % length + 1
                while at < n:
                    b, offset = bins.place(size)
                    rows.append((doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), first + b, offset))
                    at, piece, size = at + size, piece + 1, length
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=SCHEMA.replace(" long", "").replace(" int", "").split(", "))

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
