"""Operator 10, a deterministic sharded WARC writer and its reader.

Records are range-sorted by page_id. The ranges follow from the ids alone, not from a sample: ids that agree but for
their low bits, as many bits as give ranges of about RANGE_ROWS rows; ranges that prove heavy are cut again, and one id
with very many rows, like null ids, by the digest of the payload. Each range is written as gzip members, one for a
record; a new file begins with a range and when the compressed size reaches `roll_bytes`; files are named by their range
and committed through temporary names. So the files depend on the rows only, not on partitions or runs. The manifest (one
row per file: name, records, bytes, SHA-1, first and last id) is written by the same job and commits the set. Headers,
block and payload digests are made anew from the payload. Records with equal payloads of at least `revisit_from` bytes
are written once: the smallest page_id is the response, the others are revisits that refer to it. A record's id names
its page, its payload and its number among rows that agree in both, so no two are equal.

Defined results: a null html is an empty payload; a null url leaves out the target header; control characters and spaces
in a url are percent-encoded; rows that share the smallest page_id of their payload are responses all; a null page_id is
never the smallest unless its payload has no other; other columns are ignored; an empty table gives no file and an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import files
from weft.llm.common import Scratch, scratch_path, ship
from weft.operators.rank import global_rank, running_sums

DATE = "2000-01-01T00:00:00Z"
ROLL_BYTES = 16 << 20  # of a compressed file; the reader takes a file at a time
SEGMENTS = 32  # of a file
RANGE_ROWS = 2048  # rows of a range, about; four times as many make it heavy
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, payload_digest: str, number: int) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{payload_digest}:{number}>"


def record(page_id, url, payload: bytes, refers_to, is_response: bool, number: int, date: str = DATE) -> bytes:
    d = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if is_response else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, d, number)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{d}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if not is_response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, d, 0)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


SEGMENT = "start long, sub int, seq int, records long, bytes long, first_id long, last_id long, blob string, offset long"


def _segments(folder: str, segment_bytes: int, date: str):
    """Segments go into one file for each task, in the shared folder; only rows that say where they lie move on."""
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())

    def run(batches):
        at, seq, held, size, ids = None, 0, [], 0, []
        blob, out, offset = None, None, 0

        def cut():
            nonlocal blob, out, offset
            if out is None:
                blob, out = files.create(folder)
            out.write(b"".join(held))
            row = (*at, seq, len(held), size, ids[0], ids[-1], blob, offset)
            offset += size
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        last, number = (None, None, None), (None, None, -1)
        for b in batches:
            for page_id, url, html, key, first, start, sub in zip(*(b.column(x) for x in range(7))):
                i, k, f, here = page_id.as_py(), key.as_py(), first.as_py(), (start.as_py(), sub.as_py())
                if f is not None:  # says what the rows of this id and payload refer to
                    last = (i, k, f)
                    continue
                if held and here != at:
                    yield cut()
                    held, size, ids = [], 0, []
                if here != at:
                    at, seq = here, 0
                number = (i, k, number[2] + 1 if number[:2] == (i, k) else 0)
                f = last[2] if last[:2] == (i, k) else None
                payload = bytes(html.as_buffer()) if html.is_valid else b""
                one = record(i, url.as_py(), payload, f, f is None, number[2], date)
                held.append(one)
                size += len(one)
                ids.append(i)
                if size >= segment_bytes:
                    yield cut()
                    seq, held, size, ids = seq + 1, [], 0, []
        if held:
            yield cut()
        if out is not None:
            out.close()

    return run


def _writer(folder: str):
    names = ["name", "records", "bytes", "sha1", "first_id", "last_id"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(batches):
        at, rows = None, []

        def roll():
            data = []
            for blob, those in itertools.groupby(rows, key=lambda r: r[4]):
                data += files.parts(blob, [(r[5], r[3]) for r in those])
            data, name = b"".join(data), f"part-{at:012d}.warc.gz"
            files.put(folder, name, data)
            row = (name, sum(r[0] for r in rows), len(data), digest(data), rows[0][1], rows[-1][2])
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        for b in batches:
            for file, *row in zip(*(b.column(x).to_pylist() for x in range(7))):
                if rows and file != at:
                    yield roll()
                    rows = []
                at = file
                rows.append(row)
        if rows:
            yield roll()

    return run


def ranges(pages: DataFrame, scratch: Scratch, range_rows: int) -> tuple[int, list[tuple[int, DataFrame]]]:
    """The low bits that the ids of a range may differ in, and for each number of bits the heavy ranges, which are cut again (at 0 bits by payload).

    Heavy ranges number no more than rows / (4 * range_rows).
    """
    n, lo, hi = pages.agg(F.count("page_id"), F.min("page_id"), F.max("page_id")).first()
    bits = 0
    while n and (hi >> bits) - (lo >> bits) + 1 > max(1, n // range_rows):
        bits += 1
    first, heavy, left = bits, [], pages.where("page_id is not null").select("page_id")
    while n:
        cell = F.shiftright("page_id", bits).alias("_cell")
        found = scratch.keep(left.groupBy(cell).agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * range_rows).select("_cell"), f"heavy-{bits}")
        if not found.limit(1).count():
            break
        heavy.append((bits, found))
        if not bits:
            break
        left = left.join(found, F.shiftright("page_id", bits) == F.col("_cell"), "left_semi")
        bits = max(0, bits - 6)
    return first, heavy


def write(spark: SparkSession, pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, revisit_from: int = 0, date: str = DATE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write pages (page_id, url, html) to `folder`; returns the committed manifest."""
    ship(spark)
    scratch = Scratch(spark)
    p = pages.select("page_id", "url", "html")
    data = F.coalesce("html", F.lit("")).cast("binary")
    size = F.octet_length(data)
    p = p.withColumn("_d", F.concat(F.sha1(data), size.cast("string")))
    keys = scratch.keep(p.where(size >= revisit_from).groupBy("page_id", "_d").agg(F.count("*").alias("_n")), "payloads")
    first = scratch.keep(keys.groupBy("_d").agg(F.min("page_id").alias("_first")), "firsts")
    refers = keys.join(first, "_d").where("_first is not null and not (page_id <=> _first)")
    # payloads move once: what a row refers to travels as a row of its own that sorts just before it
    rows = p.withColumn("_first", F.lit(None).cast("long")).unionByName(refers.select("page_id", "_d", "_first"), allowMissingColumns=True)
    bits, heavy = ranges(pages, scratch, range_rows)
    rows = rows.withColumn("_bits", F.lit(bits))
    for b, found in heavy:
        down = F.lit(b - 6 if b > 6 else 0 if b else -1)
        there = (F.shiftright("page_id", b) == F.col("_cell")) & (F.col("_bits") == b)
        rows = rows.join(found, there, "left").withColumn("_bits", F.when(F.col("_cell").isNotNull(), down).otherwise(F.col("_bits"))).drop("_cell")
    low = F.greatest("_bits", F.lit(0))
    start = F.call_function("shiftleft", F.call_function("shiftright", F.col("page_id"), low), low)
    sub = F.when(F.col("page_id").isNull() | (F.col("_bits") < 0), F.conv(F.substring("_d", 1, 2), 16, 10).cast("int")).otherwise(0)
    rows = rows.withColumn("_start", start).withColumn("_sub", sub)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ = rows.repartition(n, "_start", "_sub").sortWithinPartitions("_start", "_sub", "page_id", "_d", F.col("_first").isNull(), "url")
    blobs = scratch.folder("blobs")
    cut = sorted_.select("page_id", "url", "html", "_d", "_first", "_start", "_sub").mapInArrow(_segments(blobs, max(1, roll_bytes // SEGMENTS), date), SEGMENT)
    segments = scratch.keep(cut, "segments")
    order = scratch.keep(global_rank(segments, F.col("start"), [F.col("start").asc_nulls_last(), F.col("sub"), F.col("seq")], "pos"), "order")
    places = running_sums(order, [], "pos", {"before": F.col("bytes")}, inclusive=False).withColumn("file", F.floor(F.col("before") / roll_bytes))
    dealt = places.repartition(n, "file").sortWithinPartitions("file", "pos")
    out = dealt.select("file", "records", "first_id", "last_id", "bytes", "blob", "offset").mapInArrow(_writer(folder), "name string, records long, bytes long, sha1 string, first_id long, last_id long")
    out.write.parquet(f"{folder}/_manifest")
    scratch.drop(*list(scratch.paths))
    return spark.read.parquet(f"{folder}/_manifest")


def records(data: bytes):
    """(headers, HTTP headers, payload) of each gzip member of an archive; digests are verified."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        raw = z.decompress(data[at:] if at else data) if len(data) - at < 1 << 16 else None
        if raw is None or not z.eof:
            z = zlib.decompressobj(31)
            raw, step, pos = b"", 1 << 16, at
            while not z.eof:
                raw += z.decompress(data[pos : pos + step])
                pos += step
            at = pos - len(z.unused_data) if pos <= len(data) else len(data) - len(z.unused_data)
        else:
            at = len(data) - len(z.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        h = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(h["Content-Length"])]
        if "sha1:" + digest(block) != h["WARC-Block-Digest"]:
            raise ValueError(f"block digest differs: {h['WARC-Record-ID']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield h, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _reader(batches):
    page = lambda x: int(v) if x and (v := re.fullmatch(r"<urn:x-page:(-?\d+|null):\w+:\d+>", x)[1]) != "null" else None
    for b in batches:
        for content in b.column(0):
            out = []
            for h, http, payload in records(bytes(content.as_buffer())):
                kind, d = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and digest(payload) != d:
                    raise ValueError(f"payload digest differs: {h['WARC-Record-ID']}")
                out.append((page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), int(http["Content-Length"]), d, kind, page(h.get("WARC-Refers-To")), payload if kind == "response" else None))
                if len(out) >= 500:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)


def _rows(out):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (of responses) of each record in the folder's archives."""
    ship(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return raw.mapInArrow(_reader, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def check(spark: SparkSession, folder: str) -> None:
    """Raise unless the folder holds just the files of its manifest, in their sizes."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    said = spark.read.parquet(f"{folder}/_manifest").select("name", "bytes")
    if there.join(said, "name", "full").where("not (length <=> bytes)").limit(1).count():
        raise ValueError(f"{folder} and its manifest differ")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    folder = scratch_path(spark, "warc")
    made = write(spark, table(spark, sf_dir, "pages"), folder)
    if not made.limit(1).count():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    check(spark, folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
