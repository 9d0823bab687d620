"""Text and table sources and sinks (survey section 2.1)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.splits import check_assignment


def pathway_list(spark: SparkSession, path: str, species: str) -> DataFrame:
    """S17. id, name of one species, from a tab-separated list without a header."""
    return spark.read.csv(path, sep="\t", schema="id string, name string, species string").where(F.col("species") == species).select("id", "name")


def events(spark: SparkSession, path: str) -> DataFrame:
    """S28."""
    return spark.read.csv(path, header=True, schema="source string, target string, time double, type string")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """S28. Missing coordinates are 0, an empty type is unk."""
    n = spark.read.csv(path, header=True, schema="node string, type string, pc1 double, pc2 double, pc3 double, pc4 double")
    return n.na.fill(0.0).withColumn("type", F.when(F.coalesce("type", F.lit("")) == "", "unk").otherwise(F.col("type")))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """S25. key, vector from lines of a key and numbers between tabs."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("key"), F.slice(parts, 2, F.size(parts) - 1).cast("array<float>").alias("vector"))


def split_cache(spark: SparkSession, path: str, seed: int, all_nodes: DataFrame) -> DataFrame:
    """S27. label, part of one seed, checked against the nodes; nodes in neither list are train."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<val:array<string>, test:array<string>>>").alias("m"))
    one = raw.select(F.col("m")[str(seed)].alias("s"))
    a = one.select(F.explode("s.val").alias("label"), F.lit("val").alias("part")).union(one.select(F.explode("s.test"), F.lit("test")))
    check_assignment(a, all_nodes)
    return all_nodes.select("label").join(a, "label", "left").select("label", F.coalesce("part", F.lit("train")).alias("part"))


def save_graph(nodes_: DataFrame, edges: DataFrame, path: str) -> None:
    """S24, S29."""
    nodes_.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_results(rows: DataFrame, path: str) -> None:
    """S29. As CSV and JSON lines."""
    rows.write.mode("overwrite").csv(f"{path}/csv", header=True)
    rows.write.mode("overwrite").json(f"{path}/json")


def latex(rows: list[dict], columns: list[str]) -> str:
    """S29. A small table as LaTeX."""
    line = lambda xs: " & ".join(str(x).replace("_", "\\_").replace("%", "\\%") for x in xs) + " \\\\"
    return "\n".join(["\\begin{tabular}{" + "l" * len(columns) + "}", line(columns), "\\hline", *(line(r[c] for c in columns) for r in rows), "\\end{tabular}"])


def best_parameters(path: str) -> dict:
    """S29. A tuner's result file."""
    with open(path) as f:
        return json.load(f)["best_params"]


def temporal_export(edges: DataFrame, ids: DataFrame, types: DataFrame) -> DataFrame:
    """S31. src_id, dst_id, type_id (-1 if unknown), time, sorted by time and then as written (seq)."""
    a, b = ids.select(F.col("label").alias("src"), F.col("id").alias("src_id")), ids.select(F.col("label").alias("dst"), F.col("id").alias("dst_id"))
    x = edges.join(a, "src").join(b, "dst").join(types.withColumnRenamed("id", "type_id"), "type", "left")
    return x.select("src_id", "dst_id", F.coalesce("type_id", F.lit(-1)).alias("type_id"), F.coalesce("time", F.lit(0)).alias("time"), "seq").sort("time", "seq")
