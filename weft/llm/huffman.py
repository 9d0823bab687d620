"""Canonical length-limited Huffman codes, packed and unpacked with numpy.

A stream is cut into blocks that begin on a byte of their own; each keeps the bit offset of every STRIDE-th id, so all
segments between checkpoints are decoded side by side by table lookups.
"""

from __future__ import annotations

import numpy as np

STRIDE = 256  # ids between checkpoints
BLOCK = 1 << 16  # ids in a block


def lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that don't occur."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    w = counts[order].astype(np.float64)
    n = len(w)
    levels = []
    packs = np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate((w, packs))
        at = np.argsort(merged, kind="stable")
        levels.append(at < n)
        s = merged[at]
        packs = s[0 : len(s) // 2 * 2 : 2] + s[1 : len(s) // 2 * 2 : 2]
    take = 2 * n - 2
    length = np.zeros(n, dtype=np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def codes(length: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by id."""
    out = np.zeros(len(length), dtype=np.uint64)
    at = np.flatnonzero(length)
    order = at[np.lexsort((at, length[at]))]
    code, last = 0, 0
    for n in np.unique(length[order]):
        ids = order[length[order] == n]
        code <<= int(n) - last
        out[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code, last = code + len(ids), int(n)
    return out


def table(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every `width`-bit prefix: its id and the bits it takes."""
    width = int(length.max()) if len(length) else 0
    c = codes(length)
    ids = np.zeros(1 << width, dtype=np.uint32)
    bits = np.ones(1 << width, dtype=np.uint8)
    for i in np.flatnonzero(length):
        lo = int(c[i]) << (width - int(length[i]))
        hi = lo + (1 << (width - int(length[i])))
        ids[lo:hi], bits[lo:hi] = i, length[i]
    return ids, bits, width


def pack(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit words of a stream, and the bit offset in it of every STRIDE-th id of each block."""
    words, marks, base = [], [], 0
    for at in range(0, len(ids), BLOCK):
        some = ids[at : at + BLOCK]
        n = length[some].astype(np.int64)
        if not n.all():
            raise ValueError("an id has no code")
        end = np.cumsum(n)
        pos = end - n
        o = (pos & 31).astype(np.uint64)
        v = code[some] << (np.uint64(64) - o - n.astype(np.uint64))
        w = pos >> 5
        size = (int(end[-1]) + 31) // 32
        hi = np.bincount(w, weights=(v >> np.uint64(32)).astype(np.float64), minlength=size + 1)
        lo = np.bincount(w + 1, weights=(v & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size + 1)
        words.append((hi[:size] + lo[:size]).astype(np.uint32))
        marks.append(pos[::STRIDE] + base)
        base += size * 32
    return (np.concatenate(words).astype(">u4"), np.concatenate(marks)) if words else (np.zeros(0, ">u4"), np.zeros(0, np.int64))


def unpack(words: np.ndarray, checkpoints: np.ndarray, n: int, tab: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids of a stream. BLOCK is a multiple of STRIDE, so every segment lies within one block."""
    ids, bits, width = tab
    out = np.zeros((len(checkpoints), STRIDE), dtype=np.uint32)
    if not n:
        return out.reshape(-1)
    words = np.concatenate((words.astype(np.uint64), np.zeros(2, dtype=np.uint64)))
    pos = checkpoints.astype(np.int64)
    top = (len(words) - 2) * 32
    for t in range(STRIDE):
        p = np.minimum(pos, top)
        w = p >> 5
        window = (((words[w] << np.uint64(32)) | words[w + 1]) << (p & 31).astype(np.uint64)) >> np.uint64(64 - width)
        out[:, t] = ids[window]
        pos = pos + bits[window]
    return out.reshape(-1)[:n]
