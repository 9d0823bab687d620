"""Operator 12, cross-tokenizer alignment: an event sweep over the token ends of two tokenizers.

Texts are encoded by both tokenizers and their token ends become events, in blocks of up to BLOCK (a row: document, offset,
side, ids, lengths). The events of A and B are united, dealt by document, sorted within partitions by offset, and streamed
through a state machine: it holds what has come of each side since the last offset where both ended, emits a group where
both end again, and a link for every stretch between two neighbouring events, which is the overlap of one A and one B
token. A document's state is a running hash, four numbers and the id pairs counted so far. Pairs are counted over the
corpus from what the sweep wrote (combined in each task first). Frequent pairs, at most FREQUENT of them, are looked up in
a table that every worker loads; all others by a join, so the table's bound cuts nothing off.

A text is encoded by pieces that begin at a space after a character that is no white space: neither tokenizer joins bytes
over such a place (tests hold pieces against whole texts; `side_b` checks B's vocabulary). Pieces are cached in each worker.

Defined results: texts that are null, empty, or that a tokenizer does not give back byte by byte have no tokens: zeros and
''; null and repeated ids and repeated rows each keep a row of their own; other columns are ignored; an empty table gives
an empty result. Texts of any length go whole; a group longer than a block is held until it ends.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import files
from weft.llm.common import Scratch, ship, table

BLOCK = 8192  # events in a row
CACHE = 400_000  # pieces, and
CACHED_CHARS = 16 << 20  # their characters, after which a worker forgets them
JOINED = 512  # new pieces encoded by one call
FREQUENT = 1_000_000  # pairs in the workers' table, 24 MB
PAIRS = 2_000_000  # pairs combined in a task before they are sent on
_CUT = re.compile(r"(?<=\S)(?= (?!\Z))")

EVENTS = "row long, doc_id long, offset long, side int, n int, ids binary"
SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"


def pieces(text: str) -> list[str]:
    """What stands after the first character, a space, of each piece of space + text."""
    found = text.split(" ")
    if "" in found or any([x[-1].isspace() for x in found]):
        return [x[1:] for x in _CUT.split(f" {text}")]
    return found


class Side:
    """A tokenizer: encode gives the ids of each of many space + pieces, whole those of one long text that begins with a space."""

    def __init__(self, encode, whole, token_bytes: list[bytes]):
        self.encode, self.whole, self.bytes = encode, whole, token_bytes
        self.size = np.array([len(x) for x in token_bytes], np.int64)
        self.kind = _kind(self.size)

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the pieces, how many each has, and whether they give it back."""
        ids, counts, good = [], [], []
        for i in range(0, len(new), JOINED):
            some = new[i : i + JOINED]
            found = self._joined(some)
            if found is None:
                each = self.encode(some)
                found = np.array(list(chain.from_iterable(each)), np.int64), np.array([len(x) for x in each])
                good += [b"".join([self.bytes[j] for j in x]) == b" " + t.encode() for t, x in zip(some, each)]
            else:
                good += [True] * len(some)
            ids.append(found[0])
            counts.append(found[1])
        return np.concatenate(ids).astype(self.kind), np.concatenate(counts), np.array(good)

    def _joined(self, some: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As learn, of pieces encoded as one text and cut where each ends; None where that cannot be."""
        if any([not x or x[-1].isspace() for x in some]):
            return None
        text = " " + " ".join(some)
        found = self.whole(text)
        if b"".join([self.bytes[j] for j in found]) != text.encode():
            return None
        ids = np.array(found, np.int64)
        stops, ends = np.cumsum([len(x.encode()) + 1 for x in some]), np.cumsum(self.size[ids])
        at = np.searchsorted(ends, stops)
        return (ids, np.diff(at, prepend=-1)) if (ends[at] == stops).all() else None


def _kind(sizes: np.ndarray) -> type:
    return np.uint16 if len(sizes) <= 1 << 16 else np.uint32


class Encoder:
    """Both sides, with the pieces that were seen before: one flat array of ids for each side."""

    def __init__(self, paths: tuple[str, str]):
        self.sides = (side_a(paths[0]), side_b(paths[1]))
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.chars = 0
        self.flat = [np.zeros(0, s.kind) for s in self.sides]
        self.start, self.count = ([np.zeros(0, np.int64)] * 2 for _ in range(2))
        self.good = np.zeros(0, bool)

    def __call__(self, docs: list[list[str]]) -> tuple[list[bool], list[list[np.ndarray]]]:
        """Whether both sides give back each document, and its ids for each side."""
        if len(self.slot) > CACHE or self.chars > CACHED_CHARS:
            self._clear()
        flat = list(chain.from_iterable(docs))
        codes = np.fromiter(map(self.slot.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            lost = [flat[i] for i in missing.tolist()]
            new = list(dict.fromkeys(lost))
            self._learn(new)
            codes[missing] = [self.slot[x] for x in lost]
        first = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        bad = np.concatenate(([0], np.cumsum(~self.good[codes])))
        ids = []
        for flat_ids, start, count in zip(self.flat, self.start, self.count):
            n = count[codes]
            end = np.concatenate(([0], np.cumsum(n)))
            got = flat_ids[np.repeat(start[codes] - end[:-1], n) + np.arange(end[-1])]
            ids.append(np.split(got, end[first[1:-1]]))
        return (bad[first[1:]] == bad[first[:-1]]).tolist(), ids

    def _learn(self, new: list[str]) -> None:
        known = len(self.good)
        good = np.ones(len(new), bool)
        for k, side in enumerate(self.sides):
            ids, n, fine = side.learn(new)
            self.start[k] = np.concatenate((self.start[k], len(self.flat[k]) + np.cumsum(n) - n))
            self.count[k] = np.concatenate((self.count[k], n))
            self.flat[k] = np.concatenate((self.flat[k], ids))
            good &= fine
        self.good = np.concatenate((self.good, good))
        self.slot.update(zip(new, range(known, known + len(new))))
        self.chars += sum(map(len, new))


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def side_a(path: str) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    to = byte_level()
    vocabulary = sorted(t.get_vocab().items(), key=lambda x: x[1])
    if [i for _, i in vocabulary] != list(range(len(vocabulary))):
        raise ValueError("ids of A are not dense")
    added = {i: x.content for i, x in t.get_added_tokens_decoder().items()}
    known = [added[i].encode() if i in added else bytes([to[c] for c in x]) for x, i in vocabulary]
    one = lambda x: t.encode_batch_fast([x], add_special_tokens=False)[0].ids
    return Side(lambda new: [e.ids for e in t.encode_batch_fast([" " + x for x in new], add_special_tokens=False)], one, known)


def side_b(path: str) -> Side:
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any("▁" in x.lstrip("▁") for x in names):
        raise ValueError("a piece of B goes on after a space; pieces of texts cannot be encoded alone")
    known = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    return Side(lambda new: sp.encode(new, num_threads=1), lambda text: sp.encode(text[1:]), known)  # it adds a space itself


_encoders: dict[tuple[str, str], Encoder] = {}


def events(paths: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of events of both sides; a document without tokens has one row, of side 2."""
    if paths not in _encoders:
        _encoders[paths] = Encoder(paths)
    encoder = _encoders[paths]
    for batch in batches:
        rows, ids, texts = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")
        at = 0
        while at < len(rows):
            some, chars = [], 0
            while at + len(some) < len(rows) and chars < 1 << 21:
                some.append(texts[at + len(some)].as_py() or "")
                chars += len(some[-1])
            good, found = encoder([pieces(t) if t else [] for t in some])
            out = []
            for i, t in enumerate(some):
                if not t or not good[i]:
                    out.append((rows[at + i], ids[at + i], 0, 2, 0, b""))
                    continue
                for k, side in enumerate(encoder.sides):
                    offset = 0
                    for j in range(0, len(found[k][i]), BLOCK):
                        x = found[k][i][j : j + BLOCK]
                        out.append((rows[at + i], ids[at + i], offset, k, len(x), pa.compress(x.tobytes(), "zstd", asbytes=True)))
                        offset += int(side.size[x].sum())
                if len(out) > 256:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)
            at += len(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["row", "doc_id", "offset", "side", "n", "ids"])


class Sweep:
    """One document's events in order of offset."""

    _text: list[np.ndarray] = []  # of each separator, the ids as decimal bytes with it

    def __init__(self):
        self.ids, self.ends = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
        self.sha, self.n, self.groups, self.links = hashlib.sha256(), [0, 0], 0, 0
        self.codes: list[np.ndarray] = []
        self.counted = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, side: int, offset: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.n[side] += len(ids)
        self.ids[side] = np.concatenate((self.ids[side], ids))
        self.ends[side] = np.concatenate((self.ends[side], offset + np.cumsum(lengths, dtype=np.int64)))
        a, b = self.ends
        if not len(a) or not len(b):
            return
        at = np.searchsorted(b, a)  # the B token in which, or with which, each A token ends
        both = b[np.minimum(at, len(b) - 1)] == a
        last = np.flatnonzero(both)
        if not len(last):
            return
        na, nb = last[-1] + 1, at[last[-1]] + 1
        self._emit(self.ids[0][:na], a[:na], self.ids[1][:nb], b[:nb], at[:na], both[:na])
        self.ids, self.ends = [self.ids[0][na:], self.ids[1][nb:]], [a[na:], b[nb:]]

    def _emit(self, a, a_end, b, b_end, at, both) -> None:
        """Groups end where both sides do; links are the stretches that end with an A token, and those that end with a B token alone."""
        in_a = np.searchsorted(a_end, b_end)
        alone = a_end[in_a] != b_end
        self.codes += [(a << 32) | b[at], (a[in_a[alone]] << 32) | b[alone]]
        self.links += len(a) + int(alone.sum())
        ga, gb = np.flatnonzero(both) + 1, np.flatnonzero(~alone) + 1  # tokens up to each group's end
        at_a = np.arange(len(a)) + np.concatenate(([0], gb[:-1]))[np.cumsum(both) - both]
        at_b = np.arange(len(b)) + ga[np.cumsum(~alone) - ~alone]
        order = np.empty(len(a) + len(b), np.int64)
        kind = np.zeros(len(order), np.int8)
        order[at_a], order[at_b] = a, b
        kind[at_a[ga - 1]], kind[at_b[gb - 1]] = 1, 2
        self.sha.update(b";"[: self.groups > 0])
        parts = self._decimals(int(order.max()))[kind, order].tolist()
        parts[-1] = parts[-1][:-1]
        self.sha.update(b"".join(parts))
        self.groups += len(ga)
        if len(self.codes) > 64:
            self._count()

    def _count(self) -> None:
        """Pairs so far, with their counts."""
        pairs, counts = np.unique(np.concatenate(self.codes), return_counts=True)
        if len(self.counted[0]):
            pairs, inv = np.unique(np.concatenate((self.counted[0], pairs)), return_inverse=True)
            counts = np.bincount(inv, np.concatenate((self.counted[1], counts))).astype(np.int64)
        self.counted, self.codes = (pairs, counts), []

    @classmethod
    def _decimals(cls, most: int) -> np.ndarray:
        if not len(cls._text) or cls._text.shape[1] <= most:
            cls._text = np.array([[b"%d%s" % (i, s) for i in range(max(most + 1, 65_536))] for s in (b",", b"|", b";")], dtype=object)
        return cls._text

    def result(self) -> tuple:
        if not self.n[0]:
            return 0, 0, 0, 0, "", b"", b""
        if self.codes:
            self._count()
        pairs, counts = self.counted
        return *self.n, self.groups, self.links, self.sha.hexdigest(), pairs.tobytes(), counts.astype(np.int32).tobytes()


def sweep(sizes: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SWEPT.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
    now, state, out, held = None, None, [], 0
    for batch in batches:
        for row, doc_id, offset, side, n, data in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "offset", "side", "n", "ids"))):
            if now is None or row != now[0]:
                if now is not None:
                    out.append((*now, *state.result()))
                    held += len(out[-1][-2])
                now, state = (row, doc_id), Sweep()
            if side < 2:
                kind = _kind(sizes[side])
                ids = np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind).astype(np.int64)
                state.add(side, offset, ids, sizes[side][ids])
            if len(out) >= 512 or held > 1 << 23:
                yield make(out)
                out, held = [], 0
    if now is not None:
        out.append((*now, *state.result()))
    if out:
        yield make(out)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n: counts of pairs, added up within the task."""

    def merged(pairs, counts):
        p, inv = np.unique(np.concatenate(pairs), return_inverse=True)
        return p, np.bincount(inv, np.concatenate(counts), len(p)).astype(np.int64)

    have, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), ([], [])
    for batch in batches:
        for p, c in zip(batch.column("pairs"), batch.column("counts")):
            waiting[0].append(np.frombuffer(p.as_buffer(), np.int64))
            waiting[1].append(np.frombuffer(c.as_buffer(), np.int32).astype(np.int64))
        if sum(map(len, waiting[0])) > PAIRS:
            have, waiting = merged([have[0], *waiting[0]], [have[1], *waiting[1]]), ([], [])
            if len(have[0]) > PAIRS:
                yield pa.record_batch({"pair": have[0], "n": have[1]})
                have = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    have = merged([have[0], *waiting[0]], [have[1], *waiting[1]])
    if len(have[0]):
        yield pa.record_batch({"pair": have[0], "n": have[1]})


def _looked_up(folder: str, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, n_best, count_sum by the frequent pairs; the pairs that are not among them."""
    parts = [np.frombuffer(files.get(f"{folder}/{x}"), np.int64).reshape(-1, 3) for x in names]
    held = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    held = held[np.argsort(held[:, 0])]
    keys, n, best = np.append(held[:, 0], np.iinfo(np.int64).max), np.append(held[:, 1], 0), np.append(held[:, 2], 0)
    for batch in batches:
        out = []
        for row, p, c in zip(batch.column("row").to_pylist(), batch.column("pairs"), batch.column("counts")):
            p, c = np.frombuffer(p.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.int32).astype(np.int64)
            at = np.searchsorted(keys, p)
            rest = keys[at] != p
            out.append((row, int((c * best[at])[~rest].sum()), int((c * n[at])[~rest].sum()), p[rest], c[rest]))
        r, b, s, ps, cs = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int64()), pa.array(ps, pa.list_(pa.int64())), pa.array(cs, pa.list_(pa.int64()))], names=["row", "n_best", "count_sum", "rare", "times"])


def _put_table(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    rows = [np.stack([np.asarray(b.column(c)) for c in ("pair", "n", "best")], 1) for b in batches if b.num_rows]
    if rows:
        name = f"part-{TaskContext.get().partitionId()}"
        files.put(folder, name, np.ascontiguousarray(np.concatenate(rows).astype(np.int64)).tobytes())
        yield pa.record_batch({"name": pa.array([name])})


def align(spark: SparkSession, docs: DataFrame, paths: tuple[str, str], frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    ship(spark)
    scratch, kept = Scratch(spark), Scratch(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    united = rows.mapInArrow(partial(events, paths), EVENTS)
    sizes = side_a(paths[0]).size, side_b(paths[1]).size
    swept = scratch.keep(united.repartition("row").sortWithinPartitions("row", "offset", "side").mapInArrow(partial(sweep, sizes), SWEPT), "swept", "zstd")
    counted = scratch.keep(swept.select("pairs", "counts").mapInArrow(_combined, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "counted")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    tops = counted.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    counts = scratch.keep(counted.withColumn("b", b).join(tops, "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best")), "counts")

    steps = {r.e: r.k for r in counts.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count("*").alias("k")).collect()}  # at most 63
    least, sum_ = 63, 0
    while least > 0 and sum_ + steps.get(least - 1, 0) <= frequent:
        least -= 1
        sum_ += steps.get(least, 0)
    often = F.floor(F.log2("n")) >= least
    folder = scratch.folder("frequent")
    names = sorted(r.name for r in counts.where(often).coalesce(8).mapInArrow(partial(_put_table, folder), "name string").collect())  # at most 8
    looked = scratch.keep(swept.select("row", "pairs", "counts").mapInArrow(partial(_looked_up, folder, names), "row long, n_best long, count_sum long, rare array<long>, times array<long>"), "looked")
    rare = looked.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    rest = rare.join(counts.where(~often), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    more = looked.select("row", "n_best", "count_sum").join(rest, "row", "left")
    more = more.select("row", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))
    out = kept.keep(swept.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(more, "row").drop("row"), "aligned")
    scratch.drop(*list(scratch.paths))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark, table(spark, sf_dir, "documents"), (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
