"""Operator 8, sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to a ring that is cut into a fixed number of cells. Cluster-side, only the number of keys in each cell is
counted; the driver walks the cells clockwise (their number is a parameter, not a function of the data): a cell's keys go
to the shard of the next virtual node, and those that overflow a full shard continue clockwise. The outcome is, for each
cell, ranges of key ranks with their shard, which is broadcast (bounded by cells + shards x virtual nodes rows); a key's
rank within its small cell then decides its shard and its slot.

Capacity: load_factor times the mean, at least; with load_factor 1 capacities are the two integers beside the mean, so
counts differ by one at most (law `rows`).

Defined results: a null text is empty; a null doc_id is hashed by its text's checksum and size; equal keys take adjacent
ranks; repeated rows are kept as rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = 16384
VIRTUAL_NODES = 128


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """Virtual nodes as (cell, shard), clockwise. A shard's nodes depend on its own number only."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % cells
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def capacities(n: int, shards: int, load_factor: float) -> list[int]:
    if load_factor <= 1:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [-(-int(load_factor * n) // shards) + 1] * shards


def walk(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS, load_factor: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank + 1, shard, slot of the first rank), the cells in order from 0."""
    left = capacities(sum(counts.values()), shards, load_factor)
    used = [0] * shards
    nodes = [x for x in ring(shards, virtual_nodes, cells) if left[x[1]]]
    out = []
    for cell in sorted(counts):
        rank, n = 0, counts[cell]
        i = bisect_left(nodes, (cell, -1))
        while rank < n:
            shard = nodes[i % len(nodes)][1]
            take = min(n - rank, left[shard])
            out.append((cell, rank, rank + take, shard, used[shard]))
            rank, used[shard], left[shard] = rank + take, used[shard] + take, left[shard] - take
            if not left[shard]:
                here = nodes[i % len(nodes)]
                nodes = [x for x in nodes if left[x[1]]]
                i = bisect_left(nodes, here)
    return out


def assign(spark: SparkSession, docs: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS, load_factor: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select("doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    keyed = keyed.withColumn("_h", F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id")))
    keyed = keyed.withColumn("_cell", F.pmod("_h", F.lit(cells)).cast("int"))
    counts = {r[0]: r[1] for r in keyed.groupBy("_cell").count().collect()}  # at most `cells` rows
    ranges = spark.createDataFrame(walk(counts, shards, virtual_nodes, cells, load_factor), "_c int, _lo long, _hi long, shard int, _slot long")
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "doc_id", "text_crc32", "size")) - 1
    ranked = keyed.withColumn("_rank", rank.cast("long"))
    on = (F.col("_cell") == F.col("_c")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return ranked.join(F.broadcast(ranges), on).select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    out = assign(spark, table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
