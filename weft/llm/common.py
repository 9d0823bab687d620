"""Shared plumbing: scratch tables in the folder that all executors share, and shipping of this package."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators are space and U+0009 to U+000D, nothing else.
SEPARATORS = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, `spark.checkpoint.dir`; where unset (tests), a new local one, set for the session.
    Only a session whose executors are threads of the driver may do without it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/weft/{label}-{uuid.uuid4().hex}"


#: Spark deletes a query's shuffle files when it ends, where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and are read again instead of recomputed.

    Tables are dropped as soon as no step reads them; what a returned DataFrame still reads is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
        path = scratch_path(self.spark, label)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        self.paths[label] = path
        _left[path] = self.spark
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, label: str) -> str:
        """A new path in the shared folder, dropped as tables are."""
        self.paths[label] = path = scratch_path(self.spark, label)
        _left[path] = self.spark
        return path

    def drop(self, *labels: str) -> None:
        """Delete tables that no later step reads."""
        for label in labels:
            path = self.paths.pop(label)
            delete(self.spark, path)
            _left.pop(path, None)


#: Paths of scratch tables that are still there, with their sessions.
_left: dict[str, SparkSession] = {}


@atexit.register
def _sweep() -> None:
    for path, spark in _left.items():
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before; its owner empties the folder
            return


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder within the shared one; nothing happens where there is none."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if fs.exists(a) and not fs.rename(a, b):
        raise OSError(f"could not move {path} to {to}")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, whatever their own path holds. Once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="weft-ship-")
    copy = os.path.join(folder, "copy", "weft")
    shutil.copytree(os.path.join(root, "weft"), copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "weft_package"), "zip", os.path.join(folder, "copy")))
    _shipped.add(sc.applicationId)


def row_key() -> Column:
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit(":"), F.col("text")), F.lit("")))
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id, text. Keys are digests: rows with the same key have the same id and text, and so the same result."""
    return docs.select(row_key().alias("key"), "doc_id", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text):
    """Array of the words of a text column; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")
