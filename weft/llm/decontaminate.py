"""Operator 9, benchmark decontamination by SimHash windows.

For every benchmark item, windows of the item's own length slide over each text. A window's SimHash is found from running
sums of shingle sign vectors; a multi-index over four 16-bit blocks, each holding every value within radius // 4 of an item's
block, finds all items within the radius (pigeonhole); exact weighted-shingle similarity (sum of minima over sum of
maxima of shingle counts) then decides. Windows that hold none of an item's shingles have similarity 0 with it, so only
windows that reach a shared shingle are fingerprinted; this loses nothing.

Distinct item texts are written by executors into block files of at most ITEMS items and ITEM_BYTES bytes in the shared
folder, each with its index, built once; the driver knows the files' names only. The blocks pass over the texts one after
the other, so that a worker loads an index once, and a task takes a bounded buffer of texts at a time. Item ids are joined to what was found.

Defined results: null, empty and blank texts are never contaminated; such items match nothing; items of fewer words than
a shingle are one shingle of all their words; A-Z are lower-cased; equal items are reported each; a repeated row is
reported for each of its rows; null doc_ids pass through; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import files
from weft.llm import tokens as tk
from weft.llm.common import Scratch, row_key, ship

ITEMS = 2000
ITEM_BYTES = 16 << 20
BUFFER = 16 << 20  # bytes of texts that blocks pass by at once
_U = np.uint64
_I = np.int64


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    bits = np.unpackbits(tk.mix(h.copy()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


class Index:
    """Fingerprints in four 16-bit tables; a table lists, for each value, the items whose block is within radius // 4."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        ones = np.array([bin(x).count("1") for x in range(1 << 16)], dtype=np.uint8)
        near = np.flatnonzero(ones <= radius // 4)
        self.tables = []
        for b in range(4):
            block = ((prints >> _U(16 * b)) & _U(0xFFFF)).astype(_I)
            values = (block[:, None] ^ near[None, :]).reshape(-1)
            order = np.argsort(values, kind="stable")
            start = np.searchsorted(values[order], np.arange((1 << 16) + 1))
            self.tables.append((start, (order // len(near)).astype(np.int32)))

    def within(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of f, item) within the radius."""
        pairs = []
        for b, (start, items) in enumerate(self.tables):
            v = ((f >> _U(16 * b)) & _U(0xFFFF)).astype(_I)
            n = start[v + 1] - start[v]
            row = np.repeat(np.arange(len(f)), n)
            at = np.repeat(start[v], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            item = items[at].astype(_I)
            ok = np.bitwise_count(f[row] ^ self.prints[item]) <= self.radius
            pairs.append(row[ok] * len(self.prints) + item[ok])
        key = np.unique(np.concatenate(pairs))
        return key // len(self.prints), key % len(self.prints)


class Benchmark:
    def __init__(self, items: list[tuple[int, str]], k: int, radius: int):
        data = [(t or "").encode() for _, t in items]
        offs = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(_I)
        _, _, h, first = tk.words(np.frombuffer(b"".join(data), dtype=np.uint8), offs, lower=True)
        self.classes = []
        sizes = np.diff(first)
        for kk in sorted({min(k, int(n)) for n in sizes if n}):
            mine = [i for i in range(len(items)) if sizes[i] and min(k, sizes[i]) == kk]
            grams = []
            for i in mine:
                w = h[first[i] : first[i + 1]]
                s, at = tk.Hasher(w), np.arange(len(w) - kk + 1)
                grams.append(s(at, at + kk))
            sets = [np.unique(g, return_counts=True) for g in grams]
            every, item = np.concatenate([u for u, _ in sets]), np.repeat(np.arange(len(mine)), [len(u) for u, _ in sets])
            order = np.argsort(every, kind="stable")
            some = np.zeros(1 << 22, dtype=bool)
            some[(every >> _U(42)).astype(_I)] = True
            prints = fingerprints(np.stack([signs(g).sum(axis=0, dtype=np.int32) for g in grams]))
            self.classes.append({"k": kk, "ids": [items[i][0] for i in mine], "words": sizes[mine], "sets": sets, "some": some, "every": every[order], "item": item[order], "index": Index(prints, radius)})


def similarity(g: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> float:
    u, c = np.unique(g, return_counts=True)
    iu, ic = own
    _, a, b = np.intersect1d(u, iu, assume_unique=True, return_indices=True)
    least = int(np.minimum(c[a], ic[b]).sum())
    return least / (int(c.sum()) + int(ic.sum()) - least)


def matches(bench: Benchmark, w: np.ndarray, least: float):
    """(item_id, similarity, first word, words) of the best window of each matched item, for the word hashes of one text."""
    for cl in bench.classes:
        k = cl["k"]
        if len(w) < k:
            continue
        span, at = tk.Hasher(w), np.arange(len(w) - k + 1)
        g = span(at, at + k)
        hit = np.flatnonzero(cl["some"][(g >> _U(42)).astype(_I)])
        pos = np.searchsorted(cl["every"], g[hit])
        pos[pos == len(cl["every"])] = 0
        ok = cl["every"][pos] == g[hit]
        hit, pos = hit[ok], pos[ok]
        if not len(hit):
            continue
        end = np.searchsorted(cl["every"], g[hit], "right")
        n = end - pos
        item = cl["item"][np.repeat(pos, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        where = np.repeat(hit, n)
        best: dict[int, tuple] = {}
        for words in np.unique(cl["words"][np.unique(item)]):
            m = int(words) - k + 1  # shingles in a window
            if len(g) < m:
                starts = np.zeros(1, dtype=_I)
                m = len(g)
            else:
                p = np.unique(where[cl["words"][item] == words])
                starts = np.unique(np.clip((p[:, None] - np.arange(m)[None, :]).reshape(-1), 0, len(g) - m))
            lo, hi = int(starts[0]), int(starts[-1]) + m
            for a in range(lo, hi, 1 << 14):
                s = starts[(starts >= a) & (starts < a + (1 << 14))]
                if not len(s):
                    continue
                part = g[a : min(hi, a + (1 << 14) + m)]
                sums = np.zeros((len(part) + 1, 64), dtype=np.int32)
                np.cumsum(signs(part), axis=0, out=sums[1:])
                row, it = cl["index"].within(fingerprints(sums[s - a + m] - sums[s - a]))
                good = cl["words"][it] == words
                for r, i in zip(row[good].tolist(), it[good].tolist()):
                    x = similarity(g[s[r] : s[r] + m], cl["sets"][i])
                    if x >= least and (i not in best or x > best[i][0]):
                        best[i] = (x, int(s[r]), m + k - 1)
        for i in sorted(best):
            yield (cl["ids"][i], *best[i])


_loaded: dict[str, Benchmark] = {}


def _load(path: str) -> Benchmark:
    """A block's index, which stays in the worker until another block is asked for."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = pickle.loads(zlib.decompress(files.get(path)))
    return _loaded[path]


def _scan(path: str, least: float, k: int):
    def scan(b: pa.Table):
        if b.num_rows:
            bench = _load(path)
            for i, j, data, offs in tk.texts(b.column(1)):
                _, _, h, first = tk.words(data, offs, lower=True)
                if not len(h):
                    continue
                rows, found = [], []
                for r in _touched(bench, h, first):
                    for x in matches(bench, h[first[r] : first[r + 1]], least):
                        rows.append(i + int(r))
                        found.append(x)
                if rows:
                    kinds = (pa.binary(), pa.float64(), pa.int64(), pa.int64())
                    ids = b.column(0).combine_chunks().take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[c] for x in found], t) for c, t in enumerate(kinds))], [b.column_names[0], "item", "similarity", "at", "n_words"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= BUFFER:
                yield from scan(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from scan(pa.Table.from_batches(held))

    return run


def _touched(bench: Benchmark, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts that hold any shingle of the benchmark, by one pass over all texts of a chunk."""
    out = []
    for cl in bench.classes:
        if len(h) < cl["k"]:
            continue
        at = np.arange(len(h) - cl["k"] + 1)
        g = tk.Hasher(h)(at, at + cl["k"])
        hit = np.flatnonzero(cl["some"][(g >> _U(42)).astype(_I)])
        hit = hit[np.isin(g[hit], cl["every"])]
        out.append(np.searchsorted(first, hit, "right") - 1)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=_I)


def _pack(folder: str, k: int, radius: int):
    """Blocks of items are indexed once and written."""

    def run(batches):
        held, size = [], 0

        def roll():
            name = f"block-{held[0][0].hex()}"
            files.put(folder, name, zlib.compress(pickle.dumps(Benchmark(held, k, radius)), 1))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (len(held) >= ITEMS or size + len(text) > ITEM_BYTES):
                    yield roll()
                    held, size = [], 0
                held.append((item, text))
                size += len(text)
        if held:
            yield roll()

    return run


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, radius: int = 20) -> DataFrame:
    """doc_id, item_id, similarity, at (first word of the best window), n_words, for each text and item that match."""
    return _matched(spark, docs.select("doc_id", "text"), "doc_id long", benchmark, k, least, radius)


def _matched(spark: SparkSession, docs: DataFrame, name: str, benchmark: DataFrame, k: int, least: float, radius: int) -> DataFrame:
    """docs: what names a row, and text. Blocks of items pass over the texts one after the other, so a worker loads each block's index once."""
    ship(spark)
    scratch = Scratch(spark)
    items = benchmark.where("text is not null").select(F.unhex(F.sha2("text", 256)).alias("item"), "item_id", "text")
    texts = scratch.keep(items.groupBy("item").agg(F.first("text").alias("text")), "items")
    parts = -(-texts.count() // ITEMS)
    packed = scratch.keep(texts.coalesce(max(1, parts)).sortWithinPartitions("item").mapInArrow(_pack(scratch.folder("index"), k, radius), "path string"), "blocks")
    paths = sorted(r.path for r in packed.collect())  # one name for a block
    out = None
    for path in paths:
        found = docs.mapInArrow(_scan(path, least, k), f"{name}, item binary, similarity double, at long, n_words long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"{name}, item binary, similarity double, at long, n_words long")
    return out.join(items.select("item", "item_id"), "item").select(name.split()[0], "item_id", "similarity", "at", "n_words")


def remove_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, radius: int = 20) -> DataFrame:
    """The rows of docs without those whose text is contaminated. Rows are told apart by id and text, so a clean row stays
    whatever else has its id; null and empty texts stay; an empty benchmark or table changes nothing; other columns pass."""
    found = _matched(spark, docs.select(row_key().alias("_bad"), "text"), "_bad binary", benchmark, k, least, radius).select("_bad").distinct()
    bad = Scratch(spark).keep(found, "contaminated")  # a table, so that Spark knows its size before it picks the join
    return docs.withColumn("_key", row_key()).join(bad, F.col("_key") == F.col("_bad"), "left_anti").drop("_key")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    out = contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "at", "n_words")
