"""Operator 7, n-gram Jaccard self-join by universe partition and pigeonhole.

A text's set holds its distinct n-word shingles (A-Z lower-cased). Sets of similar size share a scheme, which cuts the
universe of shingle hashes into m segments, d of them indexed with their one-deletion neighbourhoods too. Two sets with
Jaccard t or more differ in at most H shingles. A plain segment that differs takes one difference at least, and a segment
whose neighbourhoods differ takes two, so where m + d = H + 1 + e, what matches weighs e + 1 at least (a plain segment 1,
a neighbourhood 2). m and d are chosen by the cost of the signatures they make, with DELETIONS of the segments or more
given to neighbourhoods. The slack e is spent on plain segments only: each set skips its e most frequent ones. Signatures
with the largest hashes, as many as a set's own size allows, are left out before the shuffle.

Sets that are equal are one vertex, named by a digest of the words. Candidates within a signature's group are compared
with a pivot (the set that shares most signatures with others). In groups that then span several components, every set
outside the group's largest component is compared with all of the group, in cells of bounded size. So all candidates
share a signature; those that sizes and profiles (parities of shingle counts by bucket, a bound of the difference) rule out go no
further; the others are verified on the words themselves, a text travelling once for each set it is compared with.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; fewer than n words make one
shingle of all; rows with one id are rows of their own; null ids pass through, and a component of null ids only has a
null component_id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import tokens as tk
from weft.llm.common import Scratch, keyed, row_key, ship
from weft.llm.components import components

_U = np.uint64
_I = np.int64


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, h, first = tk.words(data, offs, lower=True)
    span = tk.Hasher(h) if len(h) < tk.CHUNK else None
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        s, x, y = (span, a, b) if span else (tk.Hasher(h[a:b]), 0, b - a)
        at = np.arange(x, max(x + 1, y - n + 1))
        out.append(np.unique(s(at, np.minimum(at + n, y))))
    return out


class Scheme:
    """Bands of set sizes, and for each band the partition and its allocation. The threshold is num / den."""

    RATIO = 1.5
    #: One segment in so many is given to one-deletion neighbourhoods, and one at least where sets may differ at all.
    DELETIONS = 64

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [1]

    def most_apart(self, both: int) -> int:
        return (self.den - self.num) * both // (self.den + self.num)

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * self.RATIO)))
        lo, hi = 0, len(self.tops) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.tops[mid] >= size else (mid + 1, hi)
        return lo

    @lru_cache(None)  # noqa: B019
    def layout(self, band: int) -> tuple[int, int, int, np.ndarray]:
        """Segments m, of which the first d with neighbourhoods, slack e, and the upper edges of the segments."""
        top = self.tops[band]
        h = self.most_apart(top + top * self.den // self.num)
        if not h:
            return 1, 0, 0, np.array([2**64 - 1], dtype=np.uint64)
        e = 1 + h // 20
        best = None
        for d in range(1 + h // self.DELETIONS, (h + 1 + e) // 2 + 1):
            m = h + 1 + e - d
            tokens = top / m
            cost = m + d * tokens + 4 * m * math.exp(1 - tokens)  # signatures, deletions, and groups of weak segments
            if best is None or cost < best[0]:
                best = (cost, m, d)
        _, m, d = best
        edges = np.array([((i + 1) << 64) // m - 1 for i in range(m)], dtype=np.uint64)
        return m, d, e, edges

    def roles(self, size: int) -> list[tuple[int, int]]:
        """(band, most shingles apart) for each scheme in which a set of this size may meet a partner."""
        own = self.band(size)
        out = [(own, self.most_apart(size + size * self.den // self.num))]
        for b in range(self.band(-(-size * self.num // self.den)), own):
            out.append((b, self.most_apart(size + self.tops[b])))
        return out

    def slack(self, size: int) -> int:
        return min(self.layout(b)[2] for b, _ in self.roles(size))

    def signatures(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of plain segments, and those of neighbourhoods."""
        value = tk.mix(u + _U(0x51ED270B))
        sums = np.zeros(len(u) + 1, dtype=np.uint64)
        np.cumsum(value, out=sums[1:])
        plain, near = [], [np.zeros(0, dtype=np.uint64)]
        for band, h in self.roles(len(u)):
            m, d, e, edges = self.layout(band)
            at = np.concatenate(([0], np.searchsorted(u, edges, "right")))
            whole = sums[at[1:]] - sums[at[:-1]]
            tag = tk.mix((_U(band) << _U(32)) | np.arange(m, dtype=np.uint64))
            sig = tk.mix(whole ^ tag)
            keep = h + 1 + e - 2 * d  # what is left to the plain segments where no neighbourhood matches
            if keep > 0:
                plain.append(np.partition(sig[d:], keep - 1)[:keep] if keep < m - d else sig[d:])
            if d:
                seg = np.repeat(np.arange(m), np.diff(at))[: at[d]]
                near += [sig[:d], tk.mix((whole[seg] - value[: at[d]]) ^ tag[seg])]
        return np.unique(np.concatenate(plain)) if plain else near[0], np.unique(np.concatenate(near))


#: Texts that a task remembers, so that it indexes copies once.
SEEN = 200_000
_INDEX = "key binary, doc_id long, v long, other long, n int, e int, plain array<long>, near array<long>, profile binary"


def profile(u: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles by bucket, as bits: where sets share a shingle both parities turn, so two sets differ in at least as many shingles as in parities."""
    size = min(max(64, 1 << (2 * len(u) - 1).bit_length()), 65536)  # two buckets a shingle at least, so that few differences fall together
    odd = np.bincount((u & _U(size - 1)).astype(_I), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(p: np.ndarray, size: int) -> np.ndarray:
    return p if p.shape[-1] == size else np.bitwise_xor.reduce(p.reshape(*p.shape[:-1], -1, size), axis=-2)


def least_apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Differences that profiles of one width show."""
    return np.bitwise_count(p ^ q).sum(axis=-1, dtype=_I)


def _lists(x: list[np.ndarray]):
    offsets = np.concatenate(([0], np.cumsum([len(y) for y in x]))).astype(np.int32)
    flat = np.concatenate(x) if x else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(_I)))


def _index(n: int, num: int, den: int):
    scheme = Scheme(num, den)
    none = np.zeros(0, dtype=np.uint64)

    def run(batches):
        seen: dict[bytes, int] = {}
        for b in batches:
            for i, j, data, offs in tk.texts(b.column(1)):
                if len(seen) > SEEN:
                    seen.clear()
                raw = bytes(data)
                names = [tk.digest(b" ".join(raw[x:y].lower().split())) for x, y in zip(offs[:-1], offs[1:])]
                ids = np.frombuffer(b"".join(names), dtype=_I).reshape(-1, 2)
                sizes, slack, plain, near, profiles = [], [], [], [], []
                for name, u in zip(names, shingle_sets(data, offs, n)):
                    p, q = (none, none) if name in seen or not len(u) else scheme.signatures(u)
                    seen[name] = 1
                    sizes.append(len(u))
                    slack.append(scheme.slack(len(u)) if len(p) else 0)
                    plain.append(p)
                    near.append(q)
                    profiles.append(profile(u).tobytes() if len(p) or len(q) else None)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(sizes, pa.int32()), pa.array(slack, pa.int32()),
                    _lists(plain), _lists(near), pa.array(profiles, pa.binary()),
                ], ["key", "doc_id", "v", "other", "n", "e", "plain", "near", "profile"])

    return run


def _allowed(num: int, den: int):
    """From (a, b, na, nb, pa, pb): the pairs that sizes and profiles allow."""

    def run(batches):
        for b in batches:
            pa_, pb = ([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in b.column(i)] for i in (4, 5))
            apart = np.array([least_apart(folded(x, min(len(x), len(y))), folded(y, min(len(x), len(y)))) for x, y in zip(pa_, pb)], dtype=_I)
            both = b.column(2).to_numpy() + b.column(3).to_numpy()
            ok = pa.array(apart * (den + num) <= (den - num) * both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return run


#: Sets that a cell holds, sets that pass by them in one cell, and texts that are compared with one text in one cell.
HELD, PASSING, TEXTS = 512, 4096, 256


def _cells(num: int, den: int):
    """From rows sorted by (sig, i, j, kind): pairs of a held set and a passing one of another component that sizes and profiles allow."""

    def run(batches):
        key, held, block = None, [], []
        for b in batches:
            sig, bi, bj, kind, v, n, label = (b.column(i).to_pylist() for i in range(7))
            a, z = [], []
            for i in range(len(v)):
                if (sig[i], bi[i], bj[i]) != key:
                    key, held, block = (sig[i], bi[i], bj[i]), [], []
                p = np.frombuffer(b.column(7)[i].as_buffer(), dtype=np.uint64)
                if kind[i] == 0:
                    held.append((v[i], n[i], label[i], p))
                    continue
                if held and not block:
                    for size in sorted({len(x[3]) for x in held}):
                        mine = [x for x in held if len(x[3]) == size]
                        block.append((*(np.array([x[c] for x in mine], dtype=_I) for c in range(3)), np.stack([x[3] for x in mine]), {}))
                for hv, hn, hl, hp, folds in block:
                    at = np.flatnonzero((hl != label[i]) & (num * hn <= den * n[i]) & (num * n[i] <= den * hn))
                    if not len(at):
                        continue
                    size = min(len(p), hp.shape[1])
                    if size not in folds:
                        folds[size] = folded(hp, size)
                    apart = least_apart(folds[size][at], folded(p, size))
                    at = at[apart * (den + num) <= (den - num) * (hn[at] + n[i])]
                    a += np.minimum(hv[at], v[i]).tolist()
                    z += np.maximum(hv[at], v[i]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return run


def _verify(n: int, num: int, den: int):
    """From rows sorted by (hub, cell, v is not null): hub, v, and whether the two texts' sets of shingles, as words, are close."""

    def run(batches):
        key, ids, hub = None, {}, frozenset()

        def shingles(text: str) -> set[bytes]:
            ws = text.encode().translate(_LOWER).split()
            raw = np.array([ids.setdefault(w, len(ids)) for w in ws], dtype=np.int32).tobytes()
            return {raw[4 * i : 4 * (i + n)] for i in range(max(1, len(ws) - n + 1))}

        for b in batches:
            a, z, ok = [], [], []
            for i, (h, c, v) in enumerate(zip(*(b.column(x).to_pylist() for x in range(3)))):
                if v is None:
                    ids = {}
                    key, hub = (h, c), shingles(b.column(3)[i].as_py())
                    continue
                if key != (h, c):
                    raise ValueError("a pair without its hub")
                mine = shingles(b.column(3)[i].as_py())
                both = len(hub & mine)
                a.append(h)
                z.append(v)
                ok.append(den * both >= num * (len(hub) + len(mine) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(ok, pa.bool_())], ["hub", "v", "ok"])

    return run


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def renamed(index: DataFrame, keep) -> DataFrame:
    """index with a vertex v for each digest (v, other). Where texts share the half v, all but one of them are named anew by a hash of both halves, until none do."""
    for i in count():
        clash = index.groupBy("v").agg(F.min("other").alias("_x"), F.max("other").alias("_y")).where("_x <> _y")
        if not clash.limit(1).count():
            return index
        mine = F.when(F.col("other") != F.col("_x"), F.xxhash64("v", "other", F.lit(i))).otherwise(F.col("v"))
        index = keep(index.join(clash.drop("_y"), "v", "left").withColumn("v", mine).drop("_x").select(*index.columns), f"index-{i}")


class Join:
    """One join over docs; `rows` has key, doc_id, n, v of every row, `labels` v and label (the least v of its component) of every linked vertex."""

    def __init__(self, spark: SparkSession, docs: DataFrame, n: int, num: int, den: int):
        ship(spark)
        self.scratch, self.docs, self.shape = Scratch(spark), keyed(docs), (n, num, den)
        keep, drop = self.scratch.keep, self.scratch.drop
        index = keep(self.docs.select("key", "text", "doc_id").mapInArrow(_index(n, num, den), _INDEX), "index")
        index = renamed(index, keep)
        self.rows = keep(index.select("key", "doc_id", "n", "v"), "rows")
        self.sets = keep(index.where("profile is not null").groupBy("v").agg(F.first("n").alias("n"), F.first("profile").alias("profile"), F.min("key").alias("key")), "sets")
        groups = self._groups(index)
        drop(*(x for x in list(self.scratch.paths) if x.startswith("index")))
        done = self._verified(self._allowed(self._with_pivots(groups)), "pivots")
        self.labels = components(done.where("ok").select("a", "b"), self.scratch, "first")
        more = self._verified(self._in_cells(self._open(groups)).distinct().join(done.select("a", "b"), ["a", "b"], "left_anti"), "cells")
        if more.where("ok").limit(1).count():
            links = done.unionByName(more).where("ok").select("a", "b")
            self.labels = components(links, self.scratch, "last")
        drop("sets", *(x for x in self.scratch.paths if x.startswith(("groups", "verified", "pairs"))))

    def _groups(self, index: DataFrame) -> DataFrame:
        """sig, v, n, score for signatures that sets may share, without what the slack allows to skip."""
        kind = lambda name: F.transform(name, lambda s: F.struct(s.alias("sig"), F.lit(name == "near").alias("near")))
        every = index.select("v", "n", "e", F.explode(F.concat(kind("plain"), kind("near"))).alias("s")).select("v", "n", "e", "s.sig", "s.near")
        often = self.scratch.keep(every.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1"), "often")
        members = self.scratch.keep(every.join(often, "sig"), "members")  # a join alone, so that Spark can split a frequent signature
        self.scratch.drop("often")
        one = members.repartition("v").groupBy("v", "sig").agg(F.first("n").alias("n"), F.first("e").alias("e"), F.first("near").alias("near"), F.first("c").alias("c"))
        order = F.row_number().over(Window.partitionBy("v").orderBy("near", F.desc("c"), "sig"))
        score = F.sum("c").over(Window.partitionBy("v"))
        out = one.withColumn("r", order).withColumn("score", score).where("near or r > e").select("sig", "v", "n", "score")
        out = self.scratch.keep(out, "groups")
        self.scratch.drop("members")
        return out

    def _texts(self, asked: DataFrame) -> DataFrame:
        """t and text of the vertices that are asked for; rows with one key give it once."""
        key = asked.select("t").distinct().join(self.sets.select(F.col("v").alias("t"), "key"), "t")
        return self.docs.select("key", "text").join(key, "key").groupBy("t").agg(F.first("text").alias("text"))

    def _with_pivots(self, groups: DataFrame) -> DataFrame:
        """a, b: each set of a group with the group's pivot."""
        _, num, den = self.shape
        pivot = groups.groupBy("sig").agg(F.count("*").alias("k"), F.max(F.struct("score", "v", "n")).alias("p")).where("k > 1")
        pivot = self.scratch.keep(pivot.select("sig", F.col("p.v").alias("hub"), F.col("p.n").alias("hn")), "pairs-pivots")
        close = (F.col("n") * num <= F.col("hn") * den) & (F.col("hn") * num <= F.col("n") * den)
        met = groups.join(pivot, "sig").where("v <> hub").where(close)
        return met.select(F.least("hub", "v").alias("a"), F.greatest("hub", "v").alias("b")).distinct()

    def _allowed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose profiles allow them."""
        _, num, den = self.shape
        x, y = (self.sets.select(F.col("v").alias(c), F.col("n").alias(f"n{c}"), F.col("profile").alias(f"p{c}")) for c in "ab")
        full = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "pa", "pb")
        return full.mapInArrow(_allowed(num, den), "a long, b long")

    def _verified(self, pairs: DataFrame, label: str) -> DataFrame:
        """a, b, ok of each pair. The end that more pairs share is the hub, whose text goes once to each cell of TEXTS others."""
        pairs = self.scratch.keep(pairs, f"pairs-allowed-{label}")
        n = pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("k"))
        ka, kb = (n.select(F.col("x").alias(c), F.col("k").alias(f"k{c}")) for c in "ab")
        both = pairs.join(ka, "a").join(kb, "b")
        turned = F.col("ka") > F.col("kb")
        hubs = both.select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("v"), F.greatest("ka", "kb").alias("k"))
        hubs = hubs.withColumn("cell", F.pmod(F.xxhash64("v"), F.ceil(F.col("k") / TEXTS)).cast("int"))
        hubs = self.scratch.keep(hubs.select("hub", "cell", "v"), f"pairs-hubs-{label}")
        heads = hubs.select("hub", "cell").distinct().select("hub", "cell", F.lit(None).cast("long").alias("v"), F.col("hub").alias("t"))
        asked = self.scratch.keep(heads.unionByName(hubs.select("hub", "cell", "v", F.col("v").alias("t"))), f"pairs-asked-{label}")
        told = asked.join(self._texts(asked), "t").select("hub", "cell", "v", "text")
        dealt = told.repartition("hub", "cell").sortWithinPartitions("hub", "cell", F.col("v").asc_nulls_first())
        done = dealt.mapInArrow(_verify(*self.shape), "hub long, v long, ok boolean")
        return self.scratch.keep(done.select(F.least("hub", "v").alias("a"), F.greatest("hub", "v").alias("b"), "ok"), f"verified-{label}")

    def _open(self, groups: DataFrame) -> DataFrame:
        """Groups whose sets are in several components, with the group's largest one, `main`. Of groups with the same sets one is enough."""
        placed = groups.select("sig", "v", "n").join(self.labels, "v", "left").select("sig", "v", "n", F.coalesce("label", "v").alias("label"))
        placed = self.scratch.keep(placed, "groups-placed")
        name = [F.bit_xor(F.xxhash64("v", F.lit(i))).alias(f"x{i}") for i in range(2)]
        sizes = placed.groupBy("sig", "label").agg(F.count("*").alias("k"), *name)
        same = [F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(2)]
        main = sizes.groupBy("sig").agg(F.count("*").alias("labels"), F.max(F.struct("k", "label")).alias("x"), F.sum("k").alias("all"), *same).where("labels > 1")
        main = main.select("sig", F.col("x.label").alias("main"), F.col("x.k").alias("inside"), "all", "x0", "x1")
        main = main.groupBy("x0", "x1", "main", "inside", "all").agg(F.min("sig").alias("sig")).drop("x0", "x1")
        return placed.join(self.scratch.keep(main, "groups-open"), "sig")

    def _in_cells(self, groups: DataFrame) -> DataFrame:
        _, num, den = self.shape
        g = groups.withColumn("bi", F.ceil((F.col("all") - F.col("inside")) / HELD)).withColumn("bj", F.ceil(F.col("all") / PASSING))
        g = self.scratch.keep(g.join(self.sets.select("v", "profile"), "v").select("sig", "v", "n", "label", "main", "bi", "bj", "profile"), "groups-profiles")
        self.scratch.drop("groups", "groups-placed", "groups-open")
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("v"), F.col(c))
        held = g.where("label <> main").select("sig", own("bi").alias("i"), upto("bj").alias("j"), F.lit(0).alias("kind"), "v", "n", "label", "profile")
        passing = g.select("sig", upto("bi").alias("i"), own("bj").alias("j"), F.lit(1).alias("kind"), "v", "n", "label", "profile")
        dealt = held.unionByName(passing).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "kind")
        return dealt.mapInArrow(_cells(num, den), "a long, b long")


def _classes(spark: SparkSession, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """key, doc_id, n, v, label (null for empty sets) of every row."""
    join = Join(spark, docs, n, num, den)
    out = join.rows.join(join.labels, "v", "left")
    return out.select("key", "doc_id", "n", "v", F.when(F.col("n") > 0, F.coalesce("label", "v")).alias("label"))


def join_classes(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links with Jaccard num / den or more) of every row."""
    scratch = Scratch(spark)
    rows = scratch.keep(_classes(spark, docs, n, num, den).select("doc_id", "n", "label"), "classes")
    names = scratch.keep(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "names")
    out = rows.join(names, "label", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_class(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each class: that of the least doc_id (nulls last). Rows with empty sets are classes of their own and all stay.

    Rows that share that id and text count as one row; of those the least by their other columns stays.
    """
    scratch = Scratch(spark)
    rows = scratch.keep(_classes(spark, docs, n, num, den), "classes")
    first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("x")).select(F.col("x.key").alias("key"))
    times = rows.where("label is not null").groupBy("key").agg(F.count("*").alias("times"))
    first = scratch.keep(first.join(times, "key"), "first")
    mine = docs.select(row_key().alias("key"), F.struct(*docs.columns).alias("row"))
    kept = mine.join(first, "key", "left")
    empty = F.length(F.regexp_replace(F.coalesce("row.text", F.lit("")), "[\\x20\\x09-\\x0D]+", "")) == 0
    out = kept.where((F.col("times") == 1) | empty).select("row")
    if first.where("times > 1").limit(1).count():
        out = out.unionByName(kept.where("times > 1").groupBy("key").agg(F.min("row").alias("row")).select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    return join_classes(spark, table(spark, sf_dir, "documents"), 4, 85, 100)
