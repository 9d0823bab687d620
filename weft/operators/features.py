"""Node features: lookups, pooling, vocabularies, dense ids (survey section 2.9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.closure import reachable, staged


def first_seen_vocabulary(x: DataFrame, value: str, order: str, unknown: bool) -> DataFrame:
    """F11, F12. value, id from 0 in the order of first sight, and <unk> after the last if wanted. One row for each value."""
    v = x.groupBy(value).agg(F.min(order).alias("_o")).withColumn("id", (F.row_number().over(Window.orderBy("_o", value)) - 1).cast("long")).select(value, "id")
    return v.unionByName(v.agg(F.lit("<unk>").alias(value), F.count("*").alias("id"))) if unknown else v


def zero_filled(nodes: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """F08."""
    return nodes.join(features, "label", "left").withColumn("feature", F.coalesce("feature", F.array_repeat(F.lit(0.0).cast("float"), width)))


def pooled(members: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """F09, F10. Mean feature of each key's members, by position."""
    x = members.join(features, "label").select(key, F.posexplode("feature").alias("pos", "v"))
    m = x.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return m.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("feature"))


def nested_pooled(members: DataFrame, things: DataFrame, nodes: DataFrame, kind: str = "complex") -> DataFrame:
    """F09. label, feature of every complex among the nodes: the mean feature of all leaves inside it, however deep.

    members: parent, child (ids). things: id, label, ord; a complex stands for the first thing of its label. nodes: label, type,
    ord, feature; one row for each label. A thing counts once however many ways lead to it, so cycles end; things whose
    label is no node lead nowhere. Leaves count if their feature is as wide as that of the first leaf that has one. A complex
    without such leaves has zeros; where no leaf has a feature, nothing is known and features are null.

    The walk goes up from the leaves that count, so what leads to none of them is never paired.
    """
    is_complex = F.coalesce(F.col("type") == kind, F.lit(False))
    known = staged(things.join(nodes.select("label", is_complex.alias("inner"), "feature"), "label").select("id", "label", "ord", "inner", F.when(~F.col("inner"), F.col("feature")).alias("feature")))
    width = nodes.where(~is_complex & F.col("feature").isNotNull()).agg(F.min_by(F.size("feature"), F.struct("ord", "label"))).first()[0]
    out = nodes.where(is_complex).select("label")
    if width is None:
        return out.select("label", F.lit(None).cast("array<double>").alias("feature"))
    leaves = known.where(~F.col("inner") & (F.size("feature") == width)).select(F.col("id").alias("root"), F.col("feature").alias("vec"))
    roots = known.where("inner").groupBy("label").agg(F.min_by("id", F.struct("ord", "id")).alias("node"))
    ends = known.where(F.col("inner") | (F.size("feature") == width)).select(F.col("id").alias("child"))
    up = members.select("parent", "child").join(ends, "child", "left_semi").join(known.where("inner").select(F.col("id").alias("parent")), "parent", "left_semi").distinct()
    found = reachable(up.select(F.col("child").alias("parent"), F.col("parent").alias("child")), leaves)
    mean = found.repartition("node").join(leaves, "root").groupBy("node").agg(*[F.avg(F.col("vec")[i].cast("double")).alias(f"v{i}") for i in range(width)])
    mean = mean.select("node", F.array(*[F.col(f"v{i}") for i in range(width)]).cast("array<double>").alias("mean"))
    out = out.join(roots, "label", "left").join(mean, "node", "left")
    return out.select("label", F.coalesce("mean", F.array_repeat(F.lit(0.0), width)).alias("feature"))


def terms_appended(nodes: DataFrame, terms: DataFrame, vectors: DataFrame, prefix: str = "GO:") -> DataFrame:
    """F10. nodes with the mean vector of their terms behind their feature; zeros where no term has a vector.

    nodes: label, location, feature; a null feature stays null. terms: label, term; repeated ones count each, and a location that
    begins with the prefix is one more. vectors: term, vec; one row for each term, all of one width.
    """
    at = nodes.where(F.col("location").startswith(prefix)).select("label", F.col("location").alias("term"))
    # Vectors are averaged with counts, so a term of a thousand repeats is read once.
    n = terms.select("label", "term").unionByName(at).groupBy("label", "term").agg(F.count("*").alias("n"))
    x = n.join(vectors.select("term", "vec"), "term").select("label", "n", F.posexplode("vec").alias("pos", "v"))
    x = x.groupBy("label", "pos").agg((F.sum(F.col("v").cast("double") * F.col("n")) / F.sum("n")).alias("v"))
    mean = x.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("mean"))
    width = vectors.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width"))
    out = nodes.join(mean, "label", "left").join(F.broadcast(width))
    own = F.transform("feature", lambda v: v.cast("double"))
    return out.withColumn("feature", F.concat(own, F.coalesce("mean", F.array_repeat(F.lit(0.0), F.col("width"))))).select(*nodes.columns)


def one_hot(value: Column, vocabulary: list[str]) -> Column:
    """F15. Zeros for values that are not in the vocabulary."""
    return F.array(*[F.coalesce((value == v).cast("int"), F.lit(0)) for v in vocabulary])


def modality(sequence: Column, smiles: Column, kind: Column) -> Column:
    """F03. dna or protein where there is a sequence, else molecule where there is SMILES, else none."""
    return F.when(sequence.isNotNull() & (sequence != ""), kind).when(smiles.isNotNull(), "molecule").otherwise("none")


def upsert(cache: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """S22. The cache with the new values over the old."""
    both = cache.select(key, value, F.lit(0).alias("_o")).unionByName(new.select(key, value, F.lit(1).alias("_o")))
    return both.groupBy(key).agg(F.max_by(value, "_o").alias(value))


def missing(ids: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """S22. Ids that the cache does not have; a cached null is there."""
    return ids.join(cache, key, "left_anti")


def message_round(edges: DataFrame, h: DataFrame) -> DataFrame:
    """L01. One round of mean message passing without weights."""
    return edges.join(h.withColumnRenamed("label", "src"), "src").groupBy(F.col("dst").alias("label")).agg(F.avg("h").alias("h"))
