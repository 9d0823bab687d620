"""Operator 3, token ids in a compact binary format: canonical length-limited Huffman codes from global counts.

Rows are range-sorted by doc_id and encoded once with the tokenizers library; ids are counted over the whole corpus
(bounded by the vocabulary) and coded; files hold runs of consecutive documents, and say in their header which (part and
row), so the order of ids over all files is known without a sort of what was written. A file stands alone: it carries the
code lengths, the ids and sizes of its documents, checkpoints, and the blocks.

A text is encoded by its parts between ASCII white space, each distinct part once per worker while its cache holds
(CACHE parts, by their bytes). The tokenizer drops white space before it splits, and none of its tokens spans any,
so this gives the ids of the whole text; `by_parts=False` encodes texts whole, for tokenizers of which that is not so.
Where the tokenizer lower-cases and keeps ASCII letters and punctuation (but for the apostrophe) in different tokens, parts
are also cut between the two and lower-cased, so that fewer are distinct; a tokenizer that fails a trial is not treated so.

Defined results: a null or empty text has the end id only; null doc_ids come first; rows with one id are in the order of
a hash of their texts and each keeps its own ids; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import files, huffman
from weft.llm import tokens as tk
from weft.llm.common import Scratch, scratch_path, ship

MAGIC = b"WEFTIDS1"
FILE_IDS = 4_000_000  # ids in a file; bounds a reader's memory
CACHE = 1_000_000
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_KIND = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 punctuation
_KIND[list((LETTERS + LETTERS.upper()).encode())] = 1
_KIND[list(PUNCTUATION.encode())] = 2
PLAIN = "|~"  # characters tried as marks between parts, before special tokens


class Encoder:
    """Ids of texts; parts seen before come from a cache by their bytes and one flat array of ids."""

    def __init__(self, path: str, by_parts: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_parts = Tokenizer.from_file(path), by_parts
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip))
        #: (string, id) that may stand between parts, so that one call encodes many; a part that holds one takes the next, or goes alone.
        self.marks = [(x, i) for x in PLAIN for i in self._alone(x)] + [(x, i) for i, x in special[:1]]
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fine = by_parts and self._trial()
        self.clear()

    def _trial(self) -> bool:
        """Whether case does not matter, and letters and punctuation that meet give the ids that each gives alone."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        own = {x: ids(x) for x in LETTERS + PUNCTUATION}
        return all(ids(x.upper()) == own[x] for x in LETTERS) and all(ids(x + y) == own[x] + own[y] and ids(y + x) == own[y] + own[x] for x in LETTERS for y in PUNCTUATION)

    def _split(self, data: np.ndarray, offs: np.ndarray):
        """The bytes that are encoded; start, end and hash of each part, and each text's first part."""
        bounds = offs
        if self.fine and len(data):
            low = data.copy()
            low[:-1] |= (((data[:-1] - np.uint8(65)) < 26) & (data[1:] < 128)).astype(np.uint8) << 5  # a letter before a combining mark stays
            low[-1:] |= ((data[-1:] - np.uint8(65)) < 26).astype(np.uint8) << 5
            raw = low.tobytes()
            if not any(x in raw for x in self.added):  # an added token is found in the text as it stands
                kind = _KIND[data]
                data, bounds = low, np.concatenate((offs, np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1))
        s, e, h, _ = tk.words(data, bounds)
        return data, s, e, h, np.searchsorted(s, offs)

    def _alone(self, x: str) -> list[int]:
        """The id of x, if it has one and keeps it between white space."""
        ids = self.tokenizer.encode(x, add_special_tokens=False).ids
        between = self.tokenizer.encode(f"{x} a {x} b {x}", add_special_tokens=False).ids
        return ids if len(ids) == 1 and between.count(ids[0]) == 3 and between[0] == between[-1] == ids[0] else []

    def clear(self):
        self.slot: dict[bytes, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts, and how many each has."""
        left, found = list(range(len(parts))), []
        for mark, own in self.marks:
            some = [i for i in left if mark not in parts[i]]
            if not some:
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([f" {mark} ".join([parts[i] for i in some])], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cut = np.concatenate(([-1], np.flatnonzero(ids == own), [len(ids)]))
            if len(cut) == len(some) + 1:  # else a part without the mark has its id
                found.append((some, ids[ids != own], np.diff(cut) - 1))
                left = [i for i in left if mark in parts[i]]
        for i in left:  # rare
            ids = np.array(self.tokenizer.encode(parts[i], add_special_tokens=False).ids, dtype=np.uint32)
            found.append(([i], ids, np.array([len(ids)])))
        if len(found) == 1:
            return found[0][1:]
        at = np.concatenate([x[0] for x in found])
        ids, size = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
        begin, order = np.cumsum(size) - size, np.argsort(at)
        begin, size = begin[order], size[order]
        return ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size

    @staticmethod
    def _equal(data: np.ndarray, s: np.ndarray, e: np.ndarray, as_: np.ndarray) -> np.ndarray:
        """Whether each word's bytes are those of the word it is taken for."""
        size = e - s
        same = size == size[as_]
        size = np.where(same & (as_ != np.arange(len(s))), size, 0)
        owner = np.repeat(np.arange(len(s)), size)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        same[owner[data[s[owner] + step] != data[s[as_[owner]] + step]]] = False
        return same

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        if not self.by_parts:
            raw = bytes(data)
            return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:])], add_special_tokens=False)]
        data, s, e, h, first = self._split(data, offs)
        _, at, inv = np.unique(h, return_index=True, return_inverse=True)
        other = ~self._equal(data, s, e, at[inv])
        if other.any():  # words that share a hash with another word stand for themselves
            at, inv = np.concatenate((at, np.flatnonzero(other))), inv.copy()
            inv[other] = len(at) - other.sum() + np.arange(other.sum())
        if len(self.slot) + len(at) > CACHE:
            self.clear()
        raw = bytes(data)
        parts = [raw[x:y] for x, y in zip(s[at].tolist(), e[at].tolist())]
        found = np.fromiter(map(self.slot.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [parts[i] for i in missing.tolist()]
            ids, size = self._encode([p.decode() for p in new])
            known = len(self.start)
            self.slot.update(zip(new, range(known, known + len(new))))
            found[missing] = known + np.arange(len(new))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, ids))
        which = found[inv]
        size = self.size[which]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[which] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
        bound = np.concatenate(([0], end))[first]
        return [ids[a:b] for a, b in zip(bound[:-1], bound[1:])]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, by_parts: bool) -> Encoder:
    """A worker's encoder, kept from task to task with its cache."""
    if (path, by_parts) not in _encoders:
        _encoders.clear()
        _encoders[path, by_parts] = Encoder(path, by_parts)
    return _encoders[path, by_parts]


def _encode(path: str, end_id: int, by_parts: bool):
    def run(batches):
        encode, part, row = encoder(path, by_parts), TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j, data, offs in tk.texts(b.column(1)):
                ids = [np.append(x, np.uint32(end_id)) for x in encode(data, offs)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(ids), pa.int32()), pa.array(range(row, row + len(ids)), pa.int64()), b.column(0).slice(i, j - i), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                ], ["part", "row", "doc_id", "ids"])
                row += len(ids)

    return run


def _count(batches):
    total = np.zeros(0, dtype=np.int64)
    for b in batches:
        for _, _, data, _ in tk.texts(b.column(0)):
            c = np.bincount(data.view("<u4"))
            if len(c) > len(total):
                total = np.concatenate((total, np.zeros(len(c) - len(total), dtype=np.int64)))
            total[: len(c)] += c
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])


def to_file(part: int, row: int, doc_ids: list, sizes: list[int], ids: np.ndarray, length: np.ndarray) -> bytes:
    words, marks = huffman.pack(ids, huffman.codes(length), length)
    segments = [
        json.dumps({"part": part, "row": row, "docs": len(doc_ids), "ids": int(len(ids)), "stride": huffman.STRIDE, "block": huffman.BLOCK}).encode(),
        zlib.compress(length.tobytes()), zlib.compress(np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes()),
        zlib.compress(np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes()), zlib.compress(np.array(sizes, dtype="<i8").tobytes()),
        zlib.compress(np.diff(marks, prepend=0).astype("<i8").tobytes()), words.tobytes(),
    ]
    return MAGIC + b"".join(struct.pack("<Q", len(x)) + x for x in segments)


def from_file(data: bytes, tab=None):
    """(header, doc_ids, sizes, ids) of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    at, seg = 8, []
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        seg.append(memoryview(data)[at + 8 : at + 8 + n])
        at += 8 + n
    head = json.loads(bytes(seg[0]))
    length, null = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in seg[1:3])
    docs, sizes, marks = (np.frombuffer(zlib.decompress(x), dtype="<i8") for x in seg[3:6])
    ids = huffman.unpack(np.frombuffer(seg[6], dtype=">u4"), np.cumsum(marks), head["ids"], (tab or huffman.table)(length))
    return head, [None if x else int(d) for x, d in zip(null, docs)], sizes, ids


def _write(folder: str, length: np.ndarray, file_ids: int):
    def run(batches):
        held, size, key = [], 0, None

        def roll():
            part, row = held[0][0], held[0][1]
            ids = np.concatenate([x[3] for x in held])
            data = to_file(part, row, [x[2] for x in held], [len(x[3]) for x in held], ids, length)
            files.put(folder, f"ids-{part:06d}-{row:010d}.bin", data)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, row, len(held), len(ids), len(data))], ["part", "row", "docs", "ids", "bytes"])

        for b in batches:
            for part, row, doc, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and ((part, row) != key or size >= file_ids):
                    yield roll()
                    held, size = [], 0
                held.append((part, row, doc, np.frombuffer(raw, dtype="<u4")))
                size += len(raw) // 4
                key = (part, row + 1)
        if held:
            yield roll()

    return run


def _read(batches):
    last: list = [None, None]

    def tab(length):
        raw = length.tobytes()
        if last[0] != raw:
            last[:] = raw, huffman.table(length)
        return last[1]

    for b in batches:
        for content in b.column(0):
            head, docs, sizes, ids = from_file(bytes(content.as_buffer()), tab)
            end = np.cumsum(sizes)
            crc = [zlib.crc32(ids[e - s : e].astype("<u4").tobytes()) for s, e in zip(sizes, end)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array([head["part"]] * n, pa.int64()), pa.array([head["row"]] * n, pa.int64()), pa.array(docs, pa.int64()), pa.array(end - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["part", "row", "doc_id", "at", "n_tokens", "ids_crc32"])


def write(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, by_parts: bool = True, file_ids: int = FILE_IDS, limit: int = 16) -> DataFrame:
    """Write the ids of all docs to files in `folder`; returns the manifest (part, row, docs, ids, bytes of each file)."""
    ship(spark)
    scratch = Scratch(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    encoded = scratch.keep(ordered.mapInArrow(_encode(tokenizer, end_id, by_parts), "part int, row long, doc_id long, ids binary"), "ids")
    counted = encoded.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    counts = np.zeros(max([r.id for r in counted], default=0) + 1, dtype=np.int64)
    counts[[r.id for r in counted]] = [r.n for r in counted]
    length = huffman.lengths(counts, limit)
    encoded.mapInArrow(_write(folder, length, file_ids), "part long, row long, docs long, ids long, bytes long").write.parquet(f"{folder}/_manifest")
    scratch.drop("ids")
    return spark.read.parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before it in the whole corpus), n_tokens, ids_crc32 of each document, decoded from the files."""
    ship(spark)
    manifest = spark.read.parquet(f"{folder}/_manifest")
    before, at = [], 0
    for r in sorted(manifest.groupBy("part").agg(F.sum("ids").alias("n")).collect()):  # a row for each partition written
        before.append((r.part, at))
        at += r.n
    parts = spark.createDataFrame(before, "part long, _before long")
    w = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("part", "row", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("_in")).join(parts, "part").select("part", "row", (F.col("_before") + F.col("_in")).alias("_base"))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("content")
    rows = raw.mapInArrow(_read, "part long, row long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "row"]).select("doc_id", (F.col("_base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to a new folder and read them back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = scratch_path(spark, "ids")
    if not write(spark, docs, folder, tokenizer).limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    return round_trip(spark, table(spark, sf_dir, "documents"))
