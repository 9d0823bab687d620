"""Static binary fuse filters (Graf and Lemire 2022) over 64-bit keys, built and probed with numpy.

Every key has three slots in three neighbouring segments; the 16-bit fingerprints in its slots add up (by exclusive or) to
its own. Keys are peeled in rounds: all keys that are alone in some slot go at once, and fingerprints are filled in
backwards. A key that was put in is always found; another is found once in 65536 times.
"""

from __future__ import annotations

import math
import struct

import numpy as np

_U = np.uint64
HEAD = struct.Struct("<QIII")  # seed, keys, segment length, segments


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + _U(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(33))


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three slots of each key: a first segment by the high bits, a place in it and in the next two by others."""
    first = ((h >> _U(32)) * _U(segments)) >> _U(32)
    inside = _U(length - 1)
    return np.stack([(first + _U(i)) * _U(length) + ((h >> _U(12 * i)) & inside if i else (h * _U(0x9E3779B97F4A7C15) >> _U(40)) & inside) for i in range(3)]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> _U(27)) * _U(0x94D049BB133111EB) >> _U(31)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter of the distinct keys (uint64)."""
    keys = np.unique(keys)
    n = len(keys)
    length = min(1 << 12, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / length) - 2)
    for seed in range(1, 1000):
        if seed % 20 == 0:
            segments += segments // 20 + 1
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        table = _fill(_slots(h, length, segments), _prints(h), (segments + 2) * length)
        if table is not None:
            return HEAD.pack(seed, n, length, segments) + table.tobytes()
    raise AssertionError("no seed peels all keys")


def _fill(slots: np.ndarray, prints: np.ndarray, size: int) -> np.ndarray | None:
    count, owner = np.zeros(size, np.int32), np.zeros(size, np.int64)
    each = np.arange(slots.shape[1])
    for s in slots:
        np.add.at(count, s, 1)
        np.bitwise_xor.at(owner, s, each)
    rounds, left = [], slots.shape[1]
    front = np.flatnonzero(count == 1)
    while len(front):
        keys, at = np.unique(owner[front], return_index=True)
        rounds.append((keys, front[at]))
        left -= len(keys)
        for s in slots:
            np.subtract.at(count, s[keys], 1)
            np.bitwise_xor.at(owner, s[keys], keys)
        touched = np.unique(slots[:, keys])
        front = touched[count[touched] == 1]
    if left:
        return None
    table = np.zeros(size, np.uint16)
    for keys, own in reversed(rounds):
        table[own] = 0
        a, b, c = slots[:, keys]
        table[own] = prints[keys] ^ table[a] ^ table[b] ^ table[c]
    return table


def probe(data: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    seed, n, length, segments = HEAD.unpack_from(data)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(data, np.uint16, offset=HEAD.size)
    h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
    a, b, c = _slots(h, length, segments)
    return table[a] ^ table[b] ^ table[c] == _prints(h)
