"""Word shingles of whole batches of texts, hashed by numpy without a step per word.

Words are runs of characters other than ASCII white space. A word's hash takes its bytes eight at a time; a
shingle's is a mix of its words' hashes by place. Both have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks of the low k bytes.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: Texts are taken in groups of about so many bytes.
GROUP_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null texts are empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return b, at - at[0]


def groups(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """The column in slices of about ``most`` bytes (or one text), with their first rows."""
    _, at = text_bytes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, column.slice(i, j - i)
        i = j


class Words:
    """The hashed words of texts, by unit: a line (``lines``) or a whole text.

    ``hashes`` has all words in order; unit u has ``count[u]`` of them from ``first[u]``. ``text`` and ``line_no`` tell a
    unit's text (a row of the column) and its number there.
    """

    def __init__(self, column: pa.Array, lines: bool, lower: bool = False):
        b, at = text_bytes(column)
        space = SPACE[b]
        first = ~space
        last = first.copy()
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        full = np.flatnonzero(np.diff(at))  # words don't run on from one text to the next
        first[at[full]] = ~space[at[full]]
        last[at[full + 1] - 1] = ~space[at[full + 1] - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hashes = hashed(LOWER[b] if lower else b, start, end)
        if lines:
            breaks = np.flatnonzero(b == 10) + 1
            unit = np.concatenate([breaks, at[:-1]])
            order = np.argsort(unit, kind="stable")  # an empty last line stands before the next text
            is_text = (order >= len(breaks)).astype(np.int64)
            unit = unit[order]
            self.text = np.cumsum(is_text) - 1
            self.line_no = np.arange(len(unit)) - np.flatnonzero(is_text)[self.text]
        else:
            unit = at[:-1]
            self.text, self.line_no = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        owner = np.searchsorted(unit, start, "right") - 1
        self.count = np.bincount(owner, minlength=len(unit)) if len(unit) else np.empty(0, np.int64)
        self.first = np.cumsum(self.count) - self.count

    def digests(self) -> np.ndarray:
        """128 bits of each unit's words: two columns of longs; zeros without words."""
        out = np.zeros((len(self.count), 2), np.uint64)
        raw, digest = self.hashes.tobytes(), xxhash.xxh3_128_digest
        some = np.flatnonzero(self.count)
        if len(some):
            a, z = self.first[some] * 8, (self.first[some] + self.count[some]) * 8
            out[some] = np.frombuffer(b"".join([digest(raw[i:j]) for i, j in zip(a.tolist(), z.tolist())]), "<u8").reshape(-1, 2)
        return out.view(np.int64)

    def shingles(self, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hash, unit) of each shingle, repeats included, units in order. Units of fewer words have none, or with ``short`` all their words as one."""
        n = np.maximum(self.count - size + 1, 0)
        unit = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n) + self.first[unit]
        h = np.zeros(len(unit), np.uint64)
        for k in range(size):
            h += self.hashes[at + k] * np.uint64(pow(int(ODD), k + 1, 1 << 64))
        h = mixed(h)
        few = np.flatnonzero((self.count > 0) & (self.count < size)) if short else []
        if len(few):
            extra = mixed(self.digests().view(np.uint64)[few, 0] + ODD)
            h, unit = np.concatenate([h, extra]), np.concatenate([unit, few])
            order = np.argsort(unit, kind="stable")
            h, unit = h[order], unit[order]
        return h, unit


def hashed(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word b[start:end]."""
    length = end - start
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    eight = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    h = length.astype(np.uint64) * ODD
    h = mixed(h ^ (eight[start] & LOW[np.minimum(length, 8)]))
    live, done = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
    while len(live):
        left = np.minimum(length[live] - done, 8)
        h[live] = mixed(h[live] * ODD ^ (eight[start[live] + done] & LOW[left]))
        done += 8
        live = live[length[live] > done]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(b[start[i] : end[i]].tobytes())
    return h


def sorted_sets(tokens: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens (below 2^63) of each unit in rising order, units in order."""
    if not len(tokens):
        return tokens, unit
    # 20 bits of the unit above the token's upper 44: one fast sort; where these tie, or there are more units, a full one
    few = int(unit[-1]) < 1 << 20
    if few:
        key = unit.astype(np.uint64) << np.uint64(44) | tokens >> np.uint64(19)
        order = np.argsort(key)
        t, u = tokens[order], unit[order]
    if not few or ((t[1:] != t[:-1]) & (key[order][1:] == key[order][:-1])).any():
        order = np.lexsort((tokens, unit))
        t, u = tokens[order], unit[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (u[1:] != u[:-1])
    return t[new], u[new]


def places(unit: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``unit`` in order: each one's number of rows, and each row's place in it from 0."""
    n = np.bincount(unit, minlength=units)
    return n, np.arange(len(unit)) - (np.cumsum(n) - n)[unit]


class Rarity:
    """The order of tokens, rarest first: by how far the count of a token's bucket is above the mean, the hot tokens last, then by hash.

    A token is 63 bits: seven of its class, 56 of its hash. Classes up to COMMON are of buckets; four above that are a
    doubling of a hot token's own count.
    """

    #: Hot tokens that the table holds at most, and that a task tells of.
    MOST, TOLD = 1 << 14, 1 << 11
    #: A token is hot if it makes up one part in so many of all, and occurs LEAST times.
    SHARE, LEAST = 1 << 20, 32
    COMMON = 63

    def __init__(self, counts: list[tuple[int, int]], buckets: np.ndarray):
        """``counts``: (hash as a long, count) of the hot tokens; ``buckets``: the counts of all tokens by their low bits."""
        mean = max(1.0, buckets.mean())
        above = np.maximum(0.0, (buckets - mean) / np.sqrt(mean))
        self.common = np.minimum(self.COMMON, 5 * np.log2(1 + above)).astype(np.uint64)
        rows = sorted(counts)
        self.hot = np.array([h for h, _ in rows], np.int64).view(np.uint64)
        order = np.argsort(self.hot)
        c = np.array([n for _, n in rows], np.float64)[order]
        self.hot = self.hot[order]
        self.level = np.minimum(127, self.COMMON + 1 + 4 * np.log2(np.maximum(c / self.LEAST, 1))).astype(np.uint64)
        self.may = np.zeros(1 << 20, bool)
        self.may[(self.hot & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        classes = self.common[(h & np.uint64(len(self.common) - 1)).astype(np.int64)]
        some = np.flatnonzero(self.may[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.hot, h[some]), len(self.hot) - 1)
            classes[some] = np.where(self.hot[at] == h[some], self.level[at], classes[some])
        return h >> np.uint64(8) | classes << np.uint64(56)


class HotTokens:
    """A task's counts of its tokens by bucket (their low bits), and of tokens that may be hot: those of buckets well above the mean."""

    BUCKETS, HELD = 1 << 15, 1 << 14

    def __init__(self):
        self.n = 0
        self.buckets = np.zeros(self.BUCKETS, np.int64)
        self.tokens, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, h: np.ndarray) -> None:
        b = (h & np.uint64(self.BUCKETS - 1)).astype(np.int64)
        self.buckets += np.bincount(b, minlength=self.BUCKETS)
        self.n += len(h)
        mean = self.n / self.BUCKETS
        some = h[self.buckets[b] > mean + 6 * np.sqrt(mean) + 3]
        if len(some):
            t, c = np.unique(np.concatenate([self.tokens, some]), return_inverse=True)
            weight = np.concatenate([self.counts, np.ones(len(some), np.int64)])
            self.tokens, self.counts = t, np.bincount(c, weights=weight).astype(np.int64)
            if len(t) > self.HELD:
                self._cut(self.HELD // 2)

    def _cut(self, most: int) -> None:
        keep = np.sort(np.argsort(-self.counts, kind="stable")[:most])
        self.tokens, self.counts = self.tokens[keep], self.counts[keep]

    def told(self, most: int = Rarity.TOLD) -> tuple[np.ndarray, np.ndarray]:
        """The tokens (as longs) and counts of the ``most`` that occur most often, more than once."""
        self._cut(most)
        some = self.counts > 1
        return self.tokens[some].view(np.int64), self.counts[some]
