"""Vectorised hashing of texts inside Arrow batches: words, n-grams, and windows sampled by their smallest n-gram.

Hashes are 64-bit, polynomial with a fixed random byte table and a final mix, so equal strings hash alike on every
executor. Arithmetic modulo 2^64 has known collisions between long structured strings, so words of over LONG bytes are
hashed by BLAKE2. These hashes only propose: where a result hangs on equality, callers compare strings, or digests of
128 bits made of the strings themselves. Work goes in pieces of bounded size; a longer text is hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes hashed at once
LONG = 64  # bytes of a word above which it is hashed by BLAKE2
_U = np.uint64
_TABLE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(2 * n, CHUNK + 1)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size + 1, b, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


class Hasher:
    """Hashes of any spans of a token sequence in constant time each."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = powers(len(tokens))
        self.sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def texts(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with at most `limit` bytes, or one longer row. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offs = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, its hash, and each text's first word (one more entry at the end)."""
    if lower:
        data = _LOWER[data]
    inside = ~_SEPARATOR[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    edge = offs[offs < len(data)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[edge] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        a = int(starts[i])
        h = Hasher(_TABLE[data[a : ends[j - 1]]])
        hashes[i:j] = h(starts[i:j] - a, ends[i:j] - a)
        i = j
    for i in np.flatnonzero(ends - starts > LONG):
        hashes[i] = np.frombuffer(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), dtype=np.uint64)[0]
    return starts, ends, hashes, np.searchsorted(starts, offs)


def digest(data: bytes) -> bytes:
    """128 bits that stand for a string."""
    return blake2b(data, digest_size=16).digest()


def byte_tokens(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (w - have)], a[w - have :]) if have < w else a


def windows_by_anchor(tokens: np.ndarray, bounds: np.ndarray, n: int, k: int) -> dict[str, np.ndarray]:
    """All windows of n tokens within one text, in runs of neighbours whose smallest k-gram (the anchor) is the same one.

    doc, start (of the first window, in its text), count (of windows), off (of the anchor after start), h (the anchor's
    hash). Equal windows have equal anchors at the same offset, wherever they stand.
    Long inputs go in pieces that share n - 1 tokens, so each window is in one run.
    """
    parts = []
    step = max(CHUNK, 4 * n)
    for at in range(0, max(1, len(tokens) - n + 1), step):
        t = tokens[at : at + step + n - 1]
        if len(t) < n:
            break
        total = len(t) - n + 1
        valid = np.zeros(total + 1, dtype=np.int32)
        lo, hi = np.clip(bounds[:-1] - at, 0, total), np.clip(bounds[1:] - n + 1 - at, 0, total)
        ok = hi > lo
        np.add.at(valid, lo[ok], 1)
        np.add.at(valid, hi[ok], -1)
        s = np.flatnonzero(np.cumsum(valid[:-1]))
        if not len(s):
            continue
        span = Hasher(t)
        g = span(slice(0, len(t) - k + 1), slice(k, len(t) + 1))
        least = sliding_min((g & _U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64), n - k + 1)
        p = (least[s] & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1))))
        s0, s1, p = s[first], s[np.concatenate((first[1:] - 1, [len(s) - 1]))], p[first]
        doc = np.searchsorted(bounds, s0 + at, "right") - 1
        parts.append((doc, s0 + at - bounds[doc], s1 - s0 + 1, p - s0, g[p]))
    names = ("doc", "start", "count", "off", "h")
    if not parts:
        return {x: np.zeros(0, dtype=np.uint64 if x == "h" else np.int64) for x in names}
    return {x: np.concatenate([y[i] for y in parts]) for i, x in enumerate(names)}
