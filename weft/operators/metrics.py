"""Ranking and classification metrics (survey section 2.12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.rank import mid_rank


def auc(x: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """E01. Mann-Whitney with mid-ranks; null where a class is absent (E15)."""
    groups = groups or []
    r = mid_rank(x.where(F.col(score).isNotNull()), score, "_r", groups)
    pos, n1, n = F.sum(F.when(F.col(label) == 1, F.col("_r"))), F.sum((F.col(label) == 1).cast("long")), F.count("*")
    value = F.try_divide(pos - n1 * (n1 + 1) / 2.0, n1 * (n - n1))
    return r.groupBy(*groups).agg(F.round(value, 6).alias("auc"), n.alias("n"))


def macro_auc(x: DataFrame, cls: str, scores: dict[str, str]) -> DataFrame:
    """E03. Mean one-against-rest AUC over the classes that are present, if there are two at least."""
    rows = x.select(F.col(cls).alias("_c"), F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(v).cast("double").alias("s")) for k, v in scores.items()])))
    per = auc(rows.withColumn("y", (F.col("_c") == F.col("k")).cast("int")), "y", "s", ["k"]).where("auc is not null")
    return per.agg(F.when(F.count("*") >= 2, F.round(F.avg("auc"), 6)).alias("macro_auc"), F.count("*").alias("classes"))


def top1(x: DataFrame, cls: str, scores: dict[str, str]) -> DataFrame:
    """E04. Accuracy of the first greatest score, and the share of the most frequent class."""
    best = F.greatest(*scores.values())
    guess = F.coalesce(*[F.when(F.col(v) == best, F.lit(k)) for k, v in scores.items()])
    counts = x.groupBy(cls).agg(F.count("*").alias("n"), F.count_if(guess == F.col(cls)).alias("hit"))
    return counts.agg(F.round(F.sum("hit") / F.sum("n"), 6).alias("accuracy"), F.round(F.max("n") / F.sum("n"), 6).alias("majority"), F.count("*").alias("present"))


def spearman(x: DataFrame, a: str, b: str, groups: list[str] | None = None) -> DataFrame:
    """E05, E11."""
    groups = groups or []
    r = mid_rank(mid_rank(x, a, "_ra", groups), b, "_rb", groups)
    return r.groupBy(*groups).agg(F.round(F.corr("_ra", "_rb"), 6).alias("rho"), F.count("*").alias("n"))


def within_groups(x: DataFrame, a: str, b: str, groups: list[str]) -> DataFrame:
    """E11. Mean and size-weighted mean of rho over groups of two or more in which both vary."""
    some = x.groupBy(*groups).agg(F.countDistinct(a).alias("_x"), F.countDistinct(b).alias("_y")).where("_x > 1 and _y > 1").select(*groups)
    per = spearman(x.join(some, groups, "left_semi"), a, b, groups)
    return per.agg(F.round(F.avg("rho"), 6).alias("mean"), F.round(F.sum(F.col("rho") * F.col("n")) / F.sum("n"), 6).alias("weighted"), F.count("*").alias("groups"))


def pair_accuracy(pairs: DataFrame, skip_score_ties: bool = False) -> DataFrame:
    """E06, E07. Share of pairs (t1, t2, s1, s2) with t1 <> t2 whose scores order them alike; a score tie counts as not
    less, or is skipped."""
    x = pairs.where("t1 <> t2")
    if skip_score_ties:
        x = x.where("s1 <> s2")
    return x.agg(F.round(F.avg(((F.col("t1") < F.col("t2")) == (F.col("s1") < F.col("s2"))).cast("double")), 6).alias("accuracy"), F.count("*").alias("pairs"))


def ranks_of_true(candidates: DataFrame) -> DataFrame:
    """E08. query, rank: one more than the candidates scored strictly above the true one. candidates: query, score, is_true."""
    true = candidates.where("is_true").groupBy("query").agg(F.max("score").alias("_t"))
    # Merged: the true ones are as many as the queries, while Spark's size check sees a narrow scan and would send them to the driver.
    return candidates.join(true.hint("merge"), "query").groupBy("query").agg((F.count_if((F.col("score") > F.col("_t")) & ~F.col("is_true")) + 1).alias("rank"))


def hits(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """E08. Hits@K and mean reciprocal rank."""
    return ranks.agg(*[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"hits_{k}") for k in ks], F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"), F.count("*").alias("n"))


def rank_error(x: DataFrame, a: str, b: str) -> DataFrame:
    """E10. Mean difference of the mid-ranks, in parts of the number of rows."""
    r = mid_rank(mid_rank(x, a, "_ra"), b, "_rb")
    return r.agg(F.round(F.avg(F.abs(F.col("_ra") - F.col("_rb"))) / F.count("*"), 6).alias("mae"))


def decode_bins(logits: str, conditional: bool):
    """E12. Bin from ordinal logits: how many probabilities are over a half; conditional ones are multiplied up first."""
    p = F.transform(logits, lambda v: 1 / (1 + F.exp(-v)))
    if not conditional:
        return F.size(F.filter(p, lambda v: v > 0.5))
    one = F.struct(F.lit(1.0).alias("p"), F.lit(0).alias("n"))
    return F.aggregate(p, one, lambda acc, v: F.struct((acc["p"] * v).alias("p"), (acc["n"] + (acc["p"] * v > 0.5).cast("int")).alias("n")))["n"]


def mean_std(x: DataFrame, by: str, value: str) -> DataFrame:
    """E14."""
    m, s = F.avg(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return x.groupBy(by).agg(F.format_string("%.3f +- %.3f", m, s).alias("text"), F.round(m, 6).alias("mean"), F.round(s, 6).alias("std"))


def softmax(x: DataFrame, group: str, score: str) -> DataFrame:
    """L09."""
    w = Window.partitionBy(group)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return x.withColumn("p", e / F.sum(e).over(w))


def running_counts(events: DataFrame) -> DataFrame:
    """L08. For each event (event, src, dst, type, time) of an unbroken order: earlier events of the same pair, of the
    turned pair, earlier ones from src and to dst, by type where it is the pair's."""
    turned = events.select("event", "time", F.col("dst").alias("src"), F.col("src").alias("dst"), "type", F.lit(0).alias("own"))
    both = events.select("event", "time", "src", "dst", "type", F.lit(1).alias("own")).unionByName(turned)
    before = lambda *by: Window.partitionBy(*by).orderBy("time", "event", *(["own"] if len(by) > 1 else [])).rowsBetween(Window.unboundedPreceding, -1)
    n = lambda c, *by: F.coalesce(F.sum(c).over(before(*by)), F.lit(0))
    x = both.withColumn("n_same", n("own", "src", "dst", "type")).select("event", "own", "n_same")
    pair = x.groupBy("event").agg(F.sum(F.when(F.col("own") == 1, F.col("n_same"))).alias("inertia"), F.sum(F.when(F.col("own") == 0, F.col("n_same"))).alias("reciprocity"))
    one = F.lit(1)
    y = events.select("event", n(one, "src").alias("out_degree"), n(one, "dst").alias("in_degree"))
    return pair.join(y, "event")


def hits_by_type(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """E09. Hits@K and reciprocal ranks within each type's pool, weighted by the queries of the type. ranks: type, rank."""
    per = ranks.groupBy("type").agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"h{k}") for k in ks], F.avg(1.0 / F.col("rank")).alias("m"), F.count("*").alias("n"))
    w = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return per.agg(*[F.round(w(f"h{k}"), 6).alias(f"hits_{k}") for k in ks], F.round(w("m"), 6).alias("mrr"), F.sum("n").alias("n"))


def tuning_score(x: DataFrame, majority: float = 0.45) -> DataFrame:
    """E13. Mean of four rescaled terms, each 0 at chance and 1 at best: AUC, top-1 accuracy over the majority share, rho, pair accuracy."""
    terms = ((F.col("auc") - 0.5) * 2, (F.col("accuracy") - majority) / (1 - majority), F.col("rho"), (F.col("pairs") - 0.5) * 2)
    return x.withColumn("score", F.round(sum(terms[1:], terms[0]) / 4, 6))
