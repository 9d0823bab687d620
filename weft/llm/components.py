"""Connected components by repeated joins: labels fall to the least neighbour's, then jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """v, label (the least v of its component) of every end of the edges (a, b). Loops until nothing changes."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), f"{name}-labels-0")
    i = 0
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["v"] == near["a"]).select("v", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        up = labels.select(F.col("v").alias("mid"), F.col("label").alias("jump"))
        new = scratch.keep(step.join(up, "mid").select("v", "old", F.least("mid", "jump").alias("label")), f"{name}-labels-{i + 1}")
        changed = new.where("label <> old").limit(1).count()
        scratch.drop(f"{name}-labels-{i}")
        labels, i = new.select("v", "label"), i + 1
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
