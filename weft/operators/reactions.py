"""Kinds of reactions and expansion of catalysts (survey section 2.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMED = ("protein", "small_molecule", "dna", "rna")


def translocations(left: DataFrame, right: DataFrame) -> DataFrame:
    """R01. reactions in which over half of the right participants with a left participant of the same name are elsewhere.

    left, right: reaction, pos, name, location, kind. Of left participants with one name the last counts.
    """
    last = left.where(F.col("kind").isin(*NAMED) & F.col("name").isNotNull()).groupBy("reaction", "name").agg(F.max_by("location", "pos").alias("was"))
    same = right.where(F.col("kind").isin(*NAMED)).join(last, ["reaction", "name"])
    return same.groupBy("reaction").agg(F.avg((~F.col("was").eqNullSafe(F.col("location"))).cast("double")).alias("moved")).where("moved > 0.5").select("reaction")


def broadcasts(left: DataFrame, right: DataFrame) -> DataFrame:
    """R02. At most three on the left, most of them DNA; over five on the right, five times as many at least, over 0.8 of them proteins or complexes. dna: bool of left rows."""
    l = left.groupBy("reaction").agg(F.count("*").alias("n"), F.avg(F.col("dna").cast("double")).alias("dna"))
    r = right.groupBy("reaction").agg(F.count("*").alias("m"), F.avg(F.col("kind").isin("protein", "complex").cast("double")).alias("made"))
    return l.join(r, "reaction").where("n <= 3 and dna > 0.5 and made > 0.8 and m >= 5 * n and m > 5").select("reaction")


def kinds(reactions: DataFrame, moved: DataFrame, cast: DataFrame) -> DataFrame:
    """R04."""
    x = reactions.join(moved.withColumn("_m", F.lit(1)), "reaction", "left").join(cast.withColumn("_b", F.lit(1)), "reaction", "left")
    return x.withColumn("kind", F.when(F.col("_m") == 1, "translocation").when(F.col("_b") == 1, "broadcast").otherwise("reaction")).drop("_m", "_b")


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """R03. reaction, pos, left id, right id: each left participant with the last right one of its name; others are dropped."""
    last = right.where(F.col("kind").isin(*NAMED) & F.col("name").isNotNull()).groupBy("reaction", "name").agg(F.max_by("id", "pos").alias("right"))
    return left.where(F.col("kind").isin(*NAMED)).join(last, ["reaction", "name"]).select("reaction", "pos", F.col("id").alias("left"), "right")
