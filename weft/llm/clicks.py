"""Operator 13, expiring click deduplication: a punctuated stream, without watermarks.

Copies of clicks are cut into batches and fed in order to a stateful query, which is started anew for each batch on one
checkpoint. A batch ends with a control row that carries its number and M, the largest hour so far; the stream sends it
to every bucket of click ids. applyInPandasWithState folds a bucket's rows of the batch into its windows, then, for the
control row, closes and removes those that M has left behind.

A bucket's state is one value, its windows packed. Buckets are hashes of ids and follow the session's shuffle partitions,
so what a task holds at once is one partition of the state and one bucket of one batch. Stores are the plain ones on the
JVM's heap, loaded for a task and dropped after it: each RocksDB store that is opened leaves about 0.6 MB of native memory
behind (its statistics are never closed), and every start opens one for each shuffle partition.

Repeats of a copy (same id, hour and hash) are counted before anything is shuffled, so a hot group of them travels as one
row for each task; rows of one id that differ in hour or hash meet in one task, since the fold is defined by their order.
M and the ends of the batches come from aggregations; the driver sees a row for each batch.

Defined results: rows without click_id or arrived_at, and those with a negative click_id, have no copies; any other null
is an empty part of the hash; repeated rows count each; other columns are ignored; an empty table gives an empty result.
Hours and microseconds are taken from the fields of the timestamps, so the session's time zone does not matter where
these have no zone.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.llm.common import Scratch, move, table

#: The function travels with its code: the executors' Python workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCHES = 10
HOLD = 48  # hours after its start that a window takes repeats
LATE = 24  # hours that M may be ahead of a row or of a window's end
BUCKETS = 16  # for each shuffle partition

#: click_id, start_hour, n_repeats, n_conflicts, conflict_crc, hash
WINDOW = "<qqqqq32s"
FED = "click_id long, hour long, hash binary, n long, crc long, control boolean, m long, batch int"
CLOSED = "click_id long, start_hour long, n_repeats long, n_conflicts long, conflict_crc long, hash binary, closed_batch long"
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "spark.sql.streaming.maxBatchesToRetainInMemory": "1",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.minDeltasForSnapshot": "1",  # most buckets change in each batch, so a delta is nearly as large as a snapshot
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a start is one batch; its stores would stay in memory
}


def fold(windows: dict[int, list], rows: Iterable[tuple], batch: int, closed: list[tuple]) -> None:
    """rows: (click_id, hour, hash, n, crc) in order. windows: the open ones by id, as [start_hour, n_repeats, n_conflicts,
    conflict_crc, hash]; changed in place. Those that a row closes are appended to closed."""
    for click, hour, mark, n, crc in rows:
        w = windows.get(click)
        if w is not None and hour > w[0] + HOLD:
            closed.append((click, *w, batch))
            w = None
        if w is None:
            w = windows[click] = [hour, 0, 0, 0, mark]
            n -= 1
        w[1] += n
        if mark != w[4]:
            w[2] += n
            w[3] += n * crc


def pack(windows: dict[int, list]) -> bytes:
    return b"".join([struct.pack(WINDOW, click, *w) for click, w in windows.items()])


def unpack(data: bytes) -> dict[int, list]:
    return {x[0]: list(x[1:]) for x in struct.iter_unpack(WINDOW, data)}


def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A bucket of click ids: its rows first, then the control row."""
    frames, ends, closed = [], None, []
    for x in rows:
        if x["control"].any():
            ends = x[x["control"]].iloc[0]
            x = x[~x["control"]]
        frames.append(x)
    batch, m = int(ends["batch"]), int(ends["m"])
    data = pd.concat(frames).sort_values(["click_id", "hour", "hash"])
    windows = unpack(state.get[0]) if state.exists else {}
    fold(windows, zip(*(data[c].tolist() for c in ("click_id", "hour", "hash", "n", "crc"))), batch, closed)
    left = {click: w for click, w in windows.items() if w[0] + HOLD >= m - LATE}
    closed += [(click, *w, batch) for click, w in windows.items() if click not in left]
    if left:
        state.update((pack(left),))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(dict(zip((x.split()[0] for x in CLOSED.split(", ")), zip(*closed)))) if closed else _none()


def _none() -> pd.DataFrame:
    return pd.DataFrame({x.split()[0]: pd.Series(dtype="object" if "binary" in x else "int64") for x in CLOSED.split(", ")})


def hours(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(ts)


def micros(ts: Column) -> Column:
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (hours(ts) * 60 + F.minute(ts)) * 60_000_000 + seconds


def copies(clicks: DataFrame) -> DataFrame:
    """click_id, hour, at (L), hash of every copy."""
    rows = clicks.where("click_id >= 0 and arrived_at is not null").select("*", F.explode(F.sequence(F.lit(0), (F.col("click_id") % 3).cast("int"))).alias("_j"))
    rows = rows.withColumn("_c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("_j").cast("string")).cast("binary")))
    rows = rows.withColumn("_hour", hours(F.col("arrived_at")) + 6 * F.col("_j") * (F.col("_c") % 10))
    parts = ("client_id", "kind", F.floor(100 * F.col("value") + 0.5), micros(F.col("ts")), "props", F.col("_c") % 3)
    text = F.concat_ws("|", *(F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("")) for x in parts))
    return rows.select("click_id", F.col("_hour").alias("hour"), (F.col("_hour") + F.floor(F.col("_c") / 10) % 200).alias("at"), F.unhex(F.sha2(text, 256)).alias("hash"))


def cut(spark: SparkSession, clicks: DataFrame, scratch: Scratch, batches: int) -> tuple[DataFrame, list[int]]:
    """The copies as batch, click_id, hour, hash, n; and for each batch the largest hour up to its end."""
    rows = copies(clicks)
    tops = scratch.keep(rows.groupBy("at").agg(F.max("hour").alias("hour")), "tops")
    ends = tops.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    if ends.lo is None:
        return rows.limit(0), []
    batch = F.floor((F.col("at") - ends.lo) * batches / (ends.hi - ends.lo + 1)).cast("int")
    most = dict(tops.groupBy(batch.alias("batch")).agg(F.max("hour")).collect())  # a row for each batch
    m = [most[0]]
    for k in range(1, batches):
        m.append(max(m[-1], most.get(k, m[-1])))
    return rows.groupBy(batch.alias("batch"), "click_id", "hour", "hash").agg(F.count("*").alias("n")), m


def windows(spark: SparkSession, clicks: DataFrame, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash of each window."""
    scratch = Scratch(spark)
    rows, m = cut(spark, clicks, scratch, batches)
    if not m:
        return spark.createDataFrame([], CLOSED)
    n = buckets or BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    waiting, watched, found, log = (scratch.folder(x) for x in ("batches", "fed", "windows", "checkpoint"))
    rows.select("click_id", "hour", "hash", "n", "batch").write.partitionBy("batch").parquet(waiting)
    before = {k: spark.conf.get(k, None) for k in STORES}
    for k, v in STORES.items():
        spark.conf.set(k, v)
    try:
        for k in range(batches):
            move(spark, f"{waiting}/batch={k}", f"{watched}/batch={k}")
            top = m[k] if k < batches - 1 else 1 << 40  # after the last batch all windows close
            spark.createDataFrame([(True, top)], "control boolean, m long").coalesce(1).write.mode("append").parquet(f"{watched}/batch={k}")
            stream(spark, watched, n, m[k - 1] - LATE if k else None).writeStream.format("parquet").option("path", found).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    scratch.drop("tops", "batches", "fed", "checkpoint")
    return spark.read.schema(CLOSED).parquet(found)


def stream(spark: SparkSession, folder: str, buckets: int, least: int | None) -> DataFrame:
    """The query of one start: rows before the hour `least` are dropped, control rows go to every bucket."""
    fed = spark.readStream.schema(FED).parquet(folder)
    control = F.coalesce("control", F.lit(False))
    if least is not None:
        fed = fed.where(F.col("control") | (F.col("hour") >= least))
    to = F.when(control, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.xxhash64("click_id"), F.lit(buckets)).cast("int")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)  # noqa: E731  pandas has no null in a column of numbers
    fed = fed.select(
        F.explode(to).alias("bucket"), zero("click_id"), zero("hour"), "hash",
        zero("n"), F.coalesce(F.crc32(F.lower(F.hex("hash")).cast("binary")), F.lit(0)).alias("crc"), control.alias("control"), zero("m"), "batch",
    )
    return fed.groupBy("bucket").applyInPandasWithState(step, CLOSED, "windows binary", "append", GroupStateTimeout.NoTimeout)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows(spark, table(spark, sf_dir, "clicks"))
    return out.select("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", F.lower(F.hex("hash")).alias("hash"))
