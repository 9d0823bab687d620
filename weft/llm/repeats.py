"""Operators 1 and 4: what repeats anywhere in a corpus, by words (phrase automata) or by bytes (sparse suffix array).

Both ask which windows of n tokens start at more than one place. Comparing all windows would shuffle a row per token, so
windows are first grouped: each belongs to its smallest k-gram (the anchor), and neighbours with the same anchor form a
run. Equal windows have equal anchors, so only runs whose anchor recurs matter; runs that are equal as a whole (ctx) are
settled by counting, each distinct one is looked at once, and windows are compared one by one only where runs with one
anchor differ, which is at the edges of repeated passages. Every step is a hash aggregation, an equi-join on nearly
unique keys, or a pass over texts; no group is collected, however many rows share an anchor.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import tokens as tk
from weft.llm.common import Scratch, keyed, ship

_I = np.int64


@dataclass(frozen=True)
class Unit:
    """What a token is, how long a window is, and how long its anchor."""

    by: str  # words or bytes
    n: int
    k: int

    def tokens(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """Tokens, each text's first token, the tokens' bytes (words parted by one space), and where each token begins there."""
        if self.by == "bytes":
            return tk.byte_tokens(data), offs, data.tobytes(), np.arange(len(data) + 1)
        s, e, h, first = tk.words(data, offs)
        size = e - s
        at = np.concatenate(([0], np.cumsum(size + 1)))
        buf = np.full(int(at[-1]), 0x20, dtype=np.uint8)
        owner = np.repeat(np.arange(len(s)), size)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        buf[at[owner] + step] = data[s[owner] + step]
        return h, first, buf.tobytes(), at

    def cut(self, tokens: list[bytes] | bytes, start: int, length: int) -> bytes:
        piece = tokens[start : start + length]
        return piece if self.by == "bytes" else b" ".join(piece)


def _scan(unit: Unit):
    gap = 1 if unit.by == "words" else 0

    def run(batches):
        for b in batches:
            for i, j, data, offs in tk.texts(b.column(1)):
                t, bounds, buf, at = unit.tokens(data, offs)
                r = tk.windows_by_anchor(t, bounds, unit.n, unit.k)
                first = bounds[r["doc"]] + r["start"]
                ends = at[first + r["count"] + unit.n - 1] - gap
                ctx = [tk.digest(buf[x:y]) for x, y in zip(at[first].tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["h"].view(_I)), pa.array(ctx, pa.binary()), b.column(0).take(pa.array(i + r["doc"])), pa.array(r["start"].astype(np.int32)), pa.array(r["count"].astype(np.int32)), pa.array(r["off"].astype(np.int32)),
                ], ["h", "ctx", "key", "start", "n", "off"])

    return run


def recurring_runs(docs: DataFrame, unit: Unit, scratch: Scratch) -> DataFrame:
    """h, ctx (a digest of all tokens of the run), key, start, n, off of each run whose anchor occurs at least twice."""
    a = scratch.keep(docs.select("key", "text").mapInArrow(_scan(unit), "h long, ctx binary, key binary, start int, n int, off int"), "anchors")
    often = scratch.keep(a.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h"), "often")
    b = scratch.keep(a.join(often, "h"), "recurring")
    scratch.drop("anchors", "often")
    return b


def distinct_runs(recurring: DataFrame, scratch: Scratch) -> DataFrame:
    """h, ctx, c (times it occurs), key and start (of one place of it), n, off, n_ctx (distinct runs with that anchor).

    Both sides of the join are tables, not aggregates, so that Spark can split an anchor that has very many runs.
    """
    g = recurring.groupBy("h", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("key", "start", "n", "off")).alias("x"))
    g = scratch.keep(g.select("h", "ctx", "c", "x.*"), "distinct")
    return g.join(scratch.keep(g.groupBy("h").agg(F.count("*").alias("n_ctx")), "per-anchor"), "h")


#: Keys of texts that a task remembers, so that of rows with one key it reads one.
SEEN = 200_000
_FETCHED = "h long, ctx binary, c long, n_ctx long, n int, off int, seg binary, wins array<binary>"


def _fetch(unit: Unit):
    """From (key, text, wanted runs) rows, each wanted run's own tokens, and digests of its windows where words of runs differ."""

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            out = []
            for key, text, want in zip(b.column(0), b.column(1), b.column(2)):
                name = key.as_py()
                if name in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(name)
                raw = bytes(text.as_buffer())
                tokens = raw.split() if unit.by == "words" else raw
                for w in want.as_py():
                    seg = unit.cut(tokens, w["start"], w["n"] + unit.n - 1)
                    wins = None
                    if unit.by == "words" and w["n_ctx"] > 1:
                        wins = [tk.digest(unit.cut(tokens, w["start"] + i, unit.n)) for i in range(w["n"])]
                    out.append((w["h"], w["ctx"], w["c"], w["n_ctx"], w["n"], w["off"], seg, wins))
                if len(out) >= 4096:
                    yield _batch(out, _FETCHED)
                    out = []
            if out:
                yield _batch(out, _FETCHED)

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, k in enumerate(kinds)], list(names))


def fetch(docs: DataFrame, runs: DataFrame, unit: Unit) -> DataFrame:
    """The tokens of distinct runs, from one text each (a few times where rows share a key). A text's list of runs is bounded by its length."""
    per_doc = runs.groupBy("key").agg(F.collect_list(F.struct("h", "ctx", "c", "n_ctx", "start", "n", "off")).alias("want"))
    joined = docs.select("key", "text").join(per_doc, "key").select("key", "text", "want")
    return joined.mapInArrow(_fetch(unit), _FETCHED)


def spans_by_text(recurring: DataFrame, located: DataFrame, scratch: Scratch) -> DataFrame:
    """key and its repeated spans (at, len in tokens), from spans (rel, len) relative to distinct runs.

    A run's spans are one row before they meet its places, so the join makes as many rows as there are places.
    """
    per_run = scratch.keep(located.groupBy("h", "ctx").agg(F.collect_set(F.struct("rel", "len")).alias("rels")), "per-run")
    met = recurring.join(per_run, ["h", "ctx"]).select("key", F.transform("rels", lambda x: F.struct((F.col("start") + x["rel"]).alias("at"), x["len"].alias("len"))).alias("s"))
    per = met.groupBy("key").agg(F.flatten(F.collect_set("s")).alias("spans"))
    return scratch.keep(per, "spans")


def marked(n: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Mask of n tokens, true where a span covers it."""
    d = np.zeros(n + 1, dtype=_I)
    np.add.at(d, at, 1)
    np.add.at(d, at + length, -1)
    return np.cumsum(d[:-1]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[::2], edge[1::2] - edge[::2]


def cut(docs: DataFrame, spans: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, n, removed, spans (maximal removed runs: from, len), kept (bytes), of every row."""

    def run(batches):
        for b in batches:
            ids, text, found = b.column(0), b.column(1), b.column(2)
            ns, removed, at, kept = [], [], [], []
            for x, y in zip(text, found):
                raw = memoryview(x.as_buffer()) if x.is_valid else b""
                ws = bytes(raw).split() if unit.by == "words" else np.frombuffer(raw, dtype=np.uint8)
                if y.is_valid:
                    v = y.values
                    m = marked(len(ws), v.field("at").to_numpy(), v.field("len").to_numpy())
                    s, ln = runs_of(m)
                    keep = list(compress(ws, ~m)) if unit.by == "words" else ws[~m]
                else:
                    s, ln, keep = np.zeros(0, _I), np.zeros(0, _I), ws
                ns.append(len(ws))
                removed.append(int(ln.sum()))
                at.append([{"at": int(p), "len": int(q)} for p, q in zip(s, ln)])
                kept.append(b" ".join(keep) if unit.by == "words" else keep.tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(removed, pa.int64()), pa.array(at, pa.list_(pa.struct([("at", pa.int64()), ("len", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n", "removed", "spans", "kept"])

    joined = docs.join(spans, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n long, removed long, spans array<struct<at: long, len: long>>, kept binary")


# Operator 1 ----------------------------------------------------------------------------------------------------------


def confirm(fetched: DataFrame, scratch: Scratch) -> DataFrame:
    """h, ctx, at: which windows of a run that occurs once also start in another run.

    Windows of one run differ from one another, so a window recurs where its run does or where two runs hold it. A run that
    was fetched twice changes nothing. The steps are tables, so that the shuffle files of each go before the next begins.
    """
    w = fetched.where("n_ctx > 1").select("h", "ctx", "c", F.posexplode("wins").alias("pos", "win"))
    often = w.groupBy("win").agg(F.max("c").alias("_c"), F.min("ctx").alias("_a"), F.max("ctx").alias("_b")).where("_c > 1 or _a <> _b").select("win")
    often = scratch.keep(often, "often-windows")
    at = scratch.keep(w.where("c = 1").join(often, "win").groupBy("h", "ctx").agg(F.collect_set("pos").alias("at")), "confirmed")
    scratch.drop("often-windows")
    return at


#: Words of patterns and texts that one automaton takes; bounds a worker's memory (about 100 bytes a word of a pattern).
SHARD_WORDS = 400_000
#: Passages and runs of one anchor that meet in one cell; an anchor with more has more cells.
CELL = 2000


def _passages(n: int):
    """h, seg of the passages of each run: all of it where it occurs twice, else its stretches of recurring windows."""

    def run(batches):
        for b in batches:
            out = []
            for h, c, count, seg, at in zip(*(b.column(i).to_pylist() for i in range(5))):
                if c > 1:
                    out.append((h, seg))
                elif at:
                    m = np.zeros(count, dtype=bool)
                    m[at] = True
                    words = seg.split()
                    out += [(h, b" ".join(words[s : s + ln + n - 1])) for s, ln in zip(*runs_of(m))]
            yield _batch(out, "h long, seg binary")

    return run


def _automata(shard_words: int):
    """From rows sorted by (h, i, j, kind): compile the passages (kind 0) of cells, up to a bound of words, into an automaton, and stream the cells' runs (kind 1) through it."""

    def locate(passages, runs):
        import ahocorasick

        ids: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for words in passages:
            automaton.add_word(tuple([ids.setdefault(w, len(ids) + 1) for w in words]))
        automaton.make_automaton()
        out = []
        for h, ctx, words in runs:
            mask = np.zeros(len(words) + 1, dtype=_I)
            for end, length in automaton.iter(tuple([ids.get(w, 0) for w in words])):
                mask[end - length + 1] += 1
                mask[end + 1] -= 1
            out += [(h, ctx, int(s), int(ln)) for s, ln in zip(*runs_of(np.cumsum(mask[:-1]) > 0))]
        return _batch(out, "h long, ctx binary, rel int, len int")

    def run(batches):
        key, passages, runs, size = None, [], [], 0
        for b in batches:
            for h, i, j, kind, ctx, seg in zip(*(b.column(x).to_pylist() for x in range(6))):
                if key != (h, i, j):
                    if size >= shard_words and passages:
                        yield locate(passages, runs)
                        passages, runs, size = [], [], 0
                    key = (h, i, j)
                words = seg.split()
                size += len(words)
                if kind:
                    runs.append((h, ctx, words))
                else:
                    passages.append(words)
        if passages:
            yield locate(passages, runs)

    return run


def located_words(fetched: DataFrame, n: int, shard_words: int, scratch: Scratch) -> DataFrame:
    """h, ctx, rel, len: where the automata find confirmed passages in distinct runs.

    Passages keep nothing but their words and their anchor, which says what shard they and the runs that may hold them go to.
    """
    part = fetched.where("c = 1").join(confirm(fetched, scratch), ["h", "ctx"]).select("h", "c", "n", "seg", "at")
    whole = fetched.where("c > 1").select("h", "c", "n", "seg", F.lit(None).cast("array<int>").alias("at"))
    found = whole.unionByName(part)
    passages = scratch.keep(found.mapInArrow(_passages(n), "h long, seg binary").distinct(), "passages")
    scratch.drop("confirmed")
    runs = fetched.select("h", "ctx", "seg")
    sizes = passages.groupBy("h").agg(F.ceil(F.count("*") / CELL).alias("bi"))
    sizes = scratch.keep(sizes.join(runs.groupBy("h").agg(F.ceil(F.count("*") / CELL).alias("bj")), "h"), "cells")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c, by: F.pmod(F.xxhash64(by), F.col(c))
    p = passages.join(sizes, "h").select("h", own("bi", "seg").alias("i"), upto("bj").alias("j"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("ctx"), "seg")
    r = runs.join(sizes, "h").select("h", upto("bi").alias("i"), own("bj", "ctx").alias("j"), F.lit(1).alias("kind"), "ctx", "seg")
    dealt = p.unionByName(r).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "kind")
    return dealt.mapInArrow(_automata(shard_words), "h long, ctx binary, rel int, len int")


def repeated_words(spark: SparkSession, docs: DataFrame, n: int = 35, k: int = 8, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Operator 1. Remove every word covered by a window of n words that also starts elsewhere.

    Recurring passages are confirmed over all texts by digests of their windows, and compiled into sharded Aho-Corasick
    automata over word ids. All text that holds an anchor of a passage is streamed through that passage's shard, each
    distinct run of it once, and only what the automata find is removed, at every place of the run.

    Returns doc_id, n (words), removed (words), spans (maximal removed runs), kept (UTF-8, words joined by one space).
    Defined results: a null or empty text has no words; texts shorter than a window lose nothing; a repeated row counts as
    another place, whatever its id; null ids pass through; other columns are ignored; an empty table gives an empty one.
    """
    ship(spark)
    unit, scratch = Unit("words", n, k), Scratch(spark)
    docs = keyed(docs)
    recurring = recurring_runs(docs, unit, scratch)
    fetched = scratch.keep(fetch(docs, distinct_runs(recurring, scratch), unit), "fetched")
    scratch.drop("distinct", "per-anchor")
    located = scratch.keep(located_words(fetched, n, shard_words, scratch), "located")
    scratch.drop("fetched", "passages", "cells")
    spans = spans_by_text(recurring, located, scratch)
    scratch.drop("recurring", "located", "per-run")
    return cut(docs, spans, unit)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    out = repeated_words(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_words"), F.col("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


# Operator 4 ----------------------------------------------------------------------------------------------------------

#: Windows a bucket sorts at once, and the runs of one anchor above which its windows are compared across buckets.
SORT_WINDOWS = 400_000
GROUP_RUNS = 1000


def multikey_sort(data: np.ndarray, pos: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of data at pos by their first n bytes, and a mask of those equal to the one before in all of them.

    Multikey quicksort with eight bytes as a character: all are sorted by the first, and then only ties by the next. Ties
    whose members prove equal to the last byte are done.
    """
    steps = [*range(0, n - 7, 8)] + ([n - 8] if n % 8 and n > 8 else [])
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    view = np.ndarray((len(padded) - 7,), ">u8", padded.tobytes(), 0, (1,))
    shift = np.uint64(8 * max(0, 8 - n))
    char = lambda at, i: view[at + (steps or [0])[i]].astype(np.uint64) >> shift
    first = char(pos, 0)
    order = np.argsort(first, kind="stable")
    same = np.concatenate(([False], first[order][1:] == first[order][:-1]))
    done = np.zeros(len(pos), dtype=bool)
    for i in range(1, len(steps)):
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied & ~done)
        if not len(at):
            break
        if i in (3, 12, 24):  # are whole groups equal?
            group = np.cumsum(~same)
            pair = at[same[at]]
            left = pair
            for j in range(i, len(steps)):
                left = left[char(pos[order[left]], j) == char(pos[order[left - 1]], j)]
            unequal = np.zeros(int(group[-1]) + 1, dtype=bool)
            unequal[group[np.setdiff1d(pair, left, assume_unique=True)]] = True
            done[at] = ~unequal[group[at]]
            at = at[~done[at]]
            if not len(at):
                break
        group = np.cumsum(~same)[at]
        sub = order[at]
        key = char(pos[sub], i)
        again = np.lexsort((key, group))
        order[at] = sub[again]
        g, x = group[again], key[again]
        same[at] = np.concatenate(([False], (g[1:] == g[:-1]) & (x[1:] == x[:-1])))
    return order, same


def stretch(n: int) -> int:
    """How many windows of one anchor are compared as one where possible. At an edge of a passage this takes about n / stretch
    comparisons of stretches and then stretch of windows, fewest near the root of n."""
    return max(1, math.isqrt(n))


def _place(rows):
    """The rows' bytes end to end, each row's base, and its anchor's offset."""
    lens = np.array([len(r[5]) for r in rows])
    base = np.concatenate(([0], np.cumsum(lens)[:-1])).astype(_I)
    return b"".join(r[5] for r in rows), base, np.array([r[4] for r in rows], dtype=_I)


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and rank within it of each of sizes.sum() things."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


_BUCKET = "h long, ctx binary, c long, rel int, cnt int, core binary, whole binary, wins array<binary>"


def _settle(rows, n: int):
    """Spans of windows that start twice within these rows, by sorting all their suffixes."""
    data, base, _ = _place(rows)
    owner, rel = _ragged(np.array([r[3] for r in rows]))
    order, same = multikey_sort(np.frombuffer(data, dtype=np.uint8), base[owner] + rel, n)
    group = np.cumsum(~same) - 1
    times = np.bincount(group, weights=np.array([min(r[2], 2) for r in rows])[owner][order])
    twice = np.zeros(len(owner), dtype=bool)
    twice[order] = times[group] > 1
    flat = np.flatnonzero(twice)
    new = np.concatenate(([True], (np.diff(flat) != 1) | (owner[flat][1:] != owner[flat][:-1]))) if len(flat) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate((first, [len(flat)])))
    return _batch([(*rows[o][:3], r, k, None, None, None) for o, r, k in zip(owner[flat[first]].tolist(), rel[flat[first]].tolist(), counts.tolist())], _BUCKET)


def _outer(rows, n: int):
    """Stretches of windows for the comparison across buckets: a digest of what all windows of the stretch share (core), of
    all of it where the stretch is whole, and of the windows themselves, each with its distance from the anchor."""
    step, out = stretch(n), []
    sign = lambda j, x: tk.digest(j.to_bytes(4, "big") + x)
    for h, ctx, c, count, off, seg in rows:
        for j in range((off - count + 1) // step, off // step + 1):  # by the windows' distance from the anchor
            top, bottom = min(off, (j + 1) * step - 1), max(off - count + 1, j * step)
            core = seg[max(0, off - j * step) : max(0, off - (j + 1) * step + 1 + n)]
            whole = sign(j, seg[off - top : off - bottom + n]) if top - bottom + 1 == step else None
            wins = [sign(d, seg[off - d : off - d + n]) for d in range(top, bottom - 1, -1)]
            out.append((h, ctx, c, off - top, top - bottom + 1, sign(j, core), whole, wins))
    return _batch(out, _BUCKET)


def _buckets(n: int, sort_windows: int, group_runs: int):
    """Sort a bucket's suffixes and find windows that start twice. Anchors that may be cut by the bucket's ends, or that have very many runs, go to the comparison across buckets."""

    def run(batches):
        held, size, group, outside = [], 0, [], True
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6))):
                if group and row[:2] == group[-1][:2]:
                    continue  # fetched twice
                if group and row[0] != group[-1][0]:
                    if outside:
                        yield _outer(group, n)
                    else:
                        held += group
                        size += sum(r[3] for r in group)
                    outside, group = False, []
                    if size >= sort_windows:
                        yield _settle(held, n)
                        held, size = [], 0
                elif len(group) >= group_runs:
                    yield _outer(group, n)
                    group, outside = [], True
                group.append(row)
        if held:
            yield _settle(held, n)
        if group:
            yield _outer(group, n)

    return run


def across_buckets(rows: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """h, ctx, rel, len of repeated spans among the stretches that buckets could not settle alone.

    A whole stretch that occurs twice is settled as one, and stands as evidence once; other stretches are taken apart into
    windows only if what all their windows share occurs twice.
    """
    o = rows.where("core is not null")
    equal = scratch.keep(o.where("whole is not null").groupBy("h", "whole").agg(F.sum("c").alias("times"), F.min("ctx").alias("one")), "stretches")
    o = scratch.keep(o.join(equal, ["h", "whole"], "left").withColumn("settled", F.coalesce(F.col("times") > 1, F.lit(False))), "outer")
    shared = scratch.keep(o.groupBy("h", "core").agg(F.sum("c").alias("_c")).where("_c > 1").select("h", "core"), "cores")
    apart = o.where("not settled or ctx = one").join(shared, ["h", "core"])
    w = apart.select("h", "ctx", "settled", F.when(F.col("settled"), 2).otherwise(F.col("c")).alias("c"), "rel", F.posexplode("wins").alias("i", "win"))
    often = scratch.keep(w.groupBy("h", "win").agg(F.sum("c").alias("_c")).where("_c > 1").select("h", "win"), "windows")
    single = w.where("not settled").join(often, ["h", "win"]).select("h", "ctx", (F.col("rel") + F.col("i")).cast("int").alias("rel"), F.lit(n).alias("len"))
    return o.where("settled").select("h", "ctx", "rel", (F.col("cnt") + n - 1).alias("len")).unionByName(single)


def repeated_bytes(spark: SparkSession, docs: DataFrame, n: int = 400, k: int = 16) -> DataFrame:
    """Operator 4. Remove every byte covered by a string of n bytes that also starts elsewhere.

    A sparse suffix array: suffixes are taken where a k-gram is the smallest of some window, and range-partitioned by
    their leading tokens with splitters that Spark samples; each bucket sorts the windows around its suffixes by
    successive keys (multikey quicksort, ties only), and anchors that reach a bucket's ends, or that have very many
    distinct surroundings, are compared across buckets by an aggregation.

    Returns doc_id, n (bytes), removed (bytes), spans (maximal removed runs), kept (bytes).
    Defined results: a null text is empty; texts shorter than a window lose nothing; a repeated row counts as another
    place, whatever its id; null ids pass through; other columns are ignored; an empty table gives an empty one.
    """
    ship(spark)
    unit, scratch = Unit("bytes", n, k), Scratch(spark)
    docs = keyed(docs)
    recurring = recurring_runs(docs, unit, scratch)
    runs = scratch.keep(distinct_runs(recurring, scratch), "runs")
    fetched = fetch(docs, runs.where("n_ctx > 1"), unit)
    lead = F.expr(f"substring(seg, off + 1, {k})")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = fetched.select("h", "ctx", "c", "n", "off", "seg", lead.alias("lead")).repartitionByRange(parts, "lead", "ctx").sortWithinPartitions("lead", "h", "ctx")
    sorted_ = scratch.keep(ranged.mapInArrow(_buckets(n, SORT_WINDOWS, GROUP_RUNS), _BUCKET), "buckets")
    alone = sorted_.where("core is null").select("h", "ctx", "rel", (F.col("cnt") + n - 1).alias("len"))
    whole = runs.where("n_ctx = 1").select("h", "ctx", F.lit(0).alias("rel"), (F.col("n") + n - 1).alias("len"))
    located = alone.unionByName(across_buckets(sorted_, n, scratch)).unionByName(whole)
    spans = spans_by_text(recurring, located, scratch)
    scratch.drop("recurring", "buckets", "runs", "distinct", "per-anchor", "per-run", "stretches", "outer", "cores", "windows")
    return cut(docs, spans, unit)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    out = repeated_bytes(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_bytes"), F.col("removed").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
