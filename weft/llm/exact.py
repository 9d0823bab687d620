"""Operator 11, exact dedup of deliveries: binary fuse filters of earlier snapshots screen the digests that come in.

Rows come in deliveries. The texts of a delivery that are equal are grouped by their SHA-256 (partial aggregation first, so
a hot text travels once for each task) into buckets by digest, which become the delivery's immutable snapshot; the filters
of a snapshot, one for each shard of digests, are written once. The digests of the next delivery are dealt and sorted by
shard and streamed past the filters of all earlier snapshots, one shard at a time; only those that a filter lets through are
joined with that snapshot's exact buckets, and there texts are compared byte by byte. Snapshots are bucketed tables, so
that join moves digests and no texts. A text's home is the first snapshot that holds it, and is where its totals meet.

Defined results: a null text counts as empty; of equal texts the row with the greatest doc_id stays, a null doc_id being
the least, and of rows with that same id exactly one; every row is in the result, repeated ones too; other columns are
ignored; an empty table gives an empty result. Long texts are hashed and compared whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import files, fuse
from weft.llm.common import Scratch, ship, table

DELIVERIES = 3
SHARD_KEYS = 100_000  # digests in a filter, about; bounds what a task holds


def digests(docs: DataFrame, delivery: Column) -> DataFrame:
    """row, delivery, doc_id, digest, text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), delivery.cast("int").alias("delivery"), "doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


class Snapshots:
    """Snapshots of one run: bucketed tables with their filters."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.scratch = spark, buckets, Scratch(spark)
        self.tables: list[DataFrame] = []
        self.filters: list[tuple[str, int]] = []  # folder, shards

    def freeze(self, grouped: DataFrame) -> DataFrame:
        """grouped (digest, n, last, text) as a bucketed table."""
        name = f"weft_snapshot_{uuid.uuid4().hex}"
        folder = self.scratch.folder(name)
        grouped.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", folder).format("parquet").saveAsTable(name)
        self.tables.append(self.spark.table(name))
        return self.tables[-1]

    def index(self, fresh: DataFrame) -> None:
        """Filters of the digests that are at home in the newest snapshot."""
        ship(self.spark)
        shards = max(1, -(-fresh.count() // SHARD_KEYS))
        folder = self.scratch.folder(f"filters-{len(self.filters)}")
        dealt = fresh.select(_shard(shards).alias("shard"), _key().alias("key")).repartition("shard").sortWithinPartitions("shard")
        dealt.mapInArrow(_write_filters(folder), "shard int").write.format("noop").mode("overwrite").save()
        self.filters.append((folder, shards))

    def screen(self, incoming: DataFrame) -> DataFrame:
        """digest, snapshot: what the filters let through."""
        out = None
        for i, (folder, shards) in enumerate(self.filters):
            dealt = incoming.select(_shard(shards).alias("shard"), "digest", _key().alias("key")).repartition("shard").sortWithinPartitions("shard")
            hits = dealt.mapInArrow(_probe(folder), "digest binary").withColumn("snapshot", F.lit(i))
            out = hits if out is None else out.unionByName(hits)
        return out

    def confirm(self, incoming: DataFrame, hits: DataFrame) -> DataFrame:
        """digest, home: hits whose text is that of the snapshot's bucket, byte by byte."""
        out = None
        for i, held in enumerate(self.tables[: len(self.filters)]):
            some = hits.where(F.col("snapshot") == i).select("digest")
            pair = some.join(incoming.select("digest", "text"), "digest").join(held.select("digest", F.col("text").alias("_held")), "digest")
            same = pair.where("text = _held").select("digest", F.lit(i).alias("home"))
            out = same if out is None else out.unionByName(same)
        return out.groupBy("digest").agg(F.min("home").alias("home"))

    def close(self) -> None:
        """Forget tables, filters and what was found by them."""
        for label in list(self.scratch.paths):
            if label.startswith("weft_snapshot_"):
                self.spark.sql(f"DROP TABLE IF EXISTS {label}")
            self.scratch.drop(label)


def _key() -> Column:
    return F.xxhash64("digest").alias("key")


def _shard(shards: int) -> Column:
    return F.pmod(F.crc32("digest"), F.lit(shards)).cast("int")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    shard = np.asarray(batch.column("shard"))
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(shard[a]), batch.slice(a, b - a)


def _write_filters(folder: str):
    def write(batches):
        def put(shard, parts):
            files.put(folder, f"shard-{shard}", fuse.build(np.concatenate(parts)))
            return pa.record_batch({"shard": pa.array([shard], pa.int32())})

        now, parts = None, []
        for batch in batches:
            for shard, x in _runs(batch):
                if shard != now and parts:
                    yield put(now, parts)
                    parts = []
                now = shard
                parts.append(np.asarray(x.column("key")).view(np.uint64))
        if parts:
            yield put(now, parts)

    return write


def _probe(folder: str):
    def probe(batches):
        now, data = None, None
        for batch in batches:
            for shard, x in _runs(batch):
                if shard != now:
                    now, data = shard, files.find(f"{folder}/shard-{shard}")
                if data is not None:
                    hit = fuse.probe(data, np.asarray(x.column("key")).view(np.uint64))
                    yield pa.record_batch({"digest": x.column("digest").filter(pa.array(hit))})

    return probe


def dedup(spark: SparkSession, docs: DataFrame, delivery: Column, deliveries: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every row. delivery: the number of a row's delivery, from 0."""
    shop = Snapshots(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scratch, held = shop.scratch, Scratch(spark)
    rows = digests(docs, delivery)
    one = None
    for i in range(deliveries):
        came = rows.where(F.col("delivery") == i)
        now = shop.freeze(came.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("last"), F.max("text").alias("text")))
        fresh = homes = now.select("digest", "n", "last", F.lit(i).alias("home"))
        if i:
            found = scratch.keep(shop.confirm(now, shop.screen(now.select("digest"))), f"found-{i}")
            homes = now.select("digest", "n", "last").join(found, "digest", "left").select("digest", "n", "last", F.coalesce("home", F.lit(i)).alias("home"))
            fresh = now.join(found, "digest", "left_anti")
        if i < deliveries - 1:
            shop.index(fresh.select("digest"))
        part = homes.withColumn("delivery", F.lit(i))
        one = part if one is None else one.unionByName(part)
    one = scratch.keep(one, "homes")
    whole = one.groupBy("digest", "home").agg(F.sum("n").alias("group_size"), F.max("last").alias("last"))
    groups = held.keep(one.select("digest", "delivery", "home").join(whole, ["digest", "home"]).select("digest", "delivery", "group_size", "last"), "groups")
    shop.close()
    out = rows.select("row", "delivery", "doc_id", "digest").join(groups, ["digest", "delivery"])
    return out.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "digest")


def deal(deliveries: int = DELIVERIES) -> Column:
    """A delivery for each row of a table that has none: by a hash of the id."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(deliveries))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark, table(spark, sf_dir, "documents"), deal(), DELIVERIES)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
