"""Operator 5, soft-membership mixing of sources to target weights. DataFrame functions only.

A naive Bayes classifier over hashed word endings is fitted on a bounded sample of a labelled table and gives every
document posteriors over domains. Nonnegative document rates are then fitted by projected gradient descent (with momentum) so that the
expected tokens of each domain, sum of rate x tokens x posterior, meet their targets in the least-squares sense. A
step needs only the domain totals, one aggregation of as many numbers as there are domains; rates never leave the cluster.

The residual is weighted by the inverse of the domains' second moments (a small matrix, aggregated once), so the step
length is 1 and each document moves by its posteriors times the weighted residual, then is cut off at 0. Rates are written every few steps, so that plans stay short.

Defined results: a null, empty or blank text has no tokens, the prior as its posteriors, and no influence; labels with a
null doc_id or of absent documents are not used; of several labels of one id the greatest domain counts (toxic over junk over clean); without labels the domains are equally likely; repeated rows count each;
null ids pass through; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import Scratch, words_of

DOMAINS = ("clean", "junk", "toxic")
#: The classifier is fitted on at most so many labelled rows, those with the least hashes of their ids.
SAMPLE_ROWS = 20_000
BUCKETS = 4096
TEMPERATURE = 2.0
STEPS = 40
TOLERANCE = 1e-4
TARGETS = {"clean": 0.85, "junk": 0.10, "toxic": 0.05}


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Number of a labelled row's domain; a null label counts as no."""
    return F.when(F.col(toxic) == 1, 2).when(F.col(quality) == 0, 1).otherwise(0)


def buckets(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.pmod(F.xxhash64(F.substring(w, -3, 3)), F.lit(BUCKETS)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[float], list[list[float]]]:
    """Log prior odds against the first domain, and for every other domain the log odds of each bucket."""
    lab = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(domain()).alias("domain"))
    sample = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows
    seen = rows.select("domain", F.explode(buckets(F.col("text"))).alias("b")).groupBy("domain", "b").count()
    counts = np.full((len(DOMAINS), BUCKETS), 0.5)
    for r in seen.collect():  # at most domains x BUCKETS
        counts[r.domain, r.b] += r["count"]
    n = np.ones(len(DOMAINS))
    for r in sample.groupBy("domain").count().collect():
        n[r.domain] += r["count"]
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return np.log(n[1:] / n[0]).tolist(), np.round(logs[1:] - logs[0], 4).tolist()


def _sum_of(values: Column) -> Column:
    """values is a literal array, folded to a constant once."""
    return F.aggregate("_b", F.lit(0.0), lambda acc, b: acc + F.get(values, b))


def posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]]) -> DataFrame:
    """doc_id, n (tokens) and p0, p1, ... of each row."""
    prior, odds = model
    d = docs.select("doc_id", buckets(F.col("text")).alias("_b"))
    scores = []
    for i, (p, w) in enumerate(zip(prior, odds)):
        total = _sum_of(F.split(F.lit(",".join(f"{x:g}" for x in w)), ",").cast("array<double>"))
        scores.append(((total + F.lit(p)) / TEMPERATURE).alias(f"_s{i + 1}"))
    d = d.select("doc_id", F.size("_b").cast("long").alias("n"), *scores)
    names = [f"_s{i + 1}" for i in range(len(prior))]
    top = F.greatest(F.lit(0.0), *names)
    e = [F.exp(F.lit(0.0) - top), *(F.exp(F.col(x) - top) for x in names)]
    whole = sum(e[1:], e[0])
    return d.select("doc_id", "n", *((x / whole).alias(f"p{i}") for i, x in enumerate(e)))


def fit_rates(scored: DataFrame, targets: list[float], scratch: Scratch, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float]]:
    """scored with the column rate, and the domain totals those rates give. targets are token totals."""
    k = len(targets)
    p = [F.col(f"p{i}") for i in range(k)]
    moments = scored.agg(*[F.coalesce(F.sum(F.col("n") * p[i] * p[j]), F.lit(0.0)) for i in range(k) for j in range(k)]).first()
    m = np.array(list(moments), dtype=float).reshape(k, k)
    weight = np.linalg.pinv(m + np.eye(k) * max(1e-9, 1e-6 * np.trace(m)))
    goal = np.array(targets, dtype=float)
    rated = scored.withColumn("rate", F.lit(1.0)).withColumn("_ahead", F.lit(1.0))
    held, speed = None, 1.0
    for step in range(steps + 1):
        # one job: the totals of the rates, to judge them, and of the rates carried on by their momentum, to move from
        sums = rated.agg(*[F.coalesce(F.sum(F.col(r) * F.col("n") * x), F.lit(0.0)) for r in ("rate", "_ahead") for x in p]).first()
        totals, ahead = np.array(list(sums), dtype=float).reshape(2, k)
        off = float(np.abs(totals - goal).sum()) / max(1.0, float(goal.sum()))
        if off <= tolerance or step == steps:
            return rated.drop("_ahead"), totals.tolist()
        move = [float(x) for x in weight @ (ahead - goal)]
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        new = F.greatest(F.lit(0.0), F.col("_ahead") - sum((p[i] * move[i] for i in range(1, k)), p[0] * move[0]))
        rated = rated.withColumn("_new", new).withColumn("_ahead", F.col("_new") + (F.col("_new") - F.col("rate")) * ((speed - 1) / faster))
        rated, speed = rated.withColumn("rate", F.col("_new")).drop("_new"), faster
        if step % 4 == 3:
            label = f"rates-{step}"
            rated = scratch.keep(rated, label)
            if held:
                scratch.drop(held)
            held = label
    raise AssertionError


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """doc_id, n, p0.., rate of each row: rates for domain totals of shares x total (default: the tokens there are)."""
    shares = shares or TARGETS
    scratch = Scratch(spark)
    scored = scratch.keep(posteriors(docs, fit(docs, labels)), "posteriors")
    if total is None:
        total = float(scored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    goal = [total * shares[x] / math.fsum(shares.values()) for x in DOMAINS]
    return fit_rates(scored, goal, scratch)[0]


def draw(docs: DataFrame, rates: DataFrame, seed: int = 1) -> DataFrame:
    """Each row of docs as many times as its rate says: the whole part, and one more with the chance of the rest, drawn by a hash of the id. Rows with one id share the mean of their rates."""
    one = rates.groupBy(F.col("doc_id").alias("_id")).agg(F.avg("rate").alias("_rate"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(F.col("_rate") + chance).cast("int")
    joined = docs.join(one, docs["doc_id"].eqNullSafe(one["_id"])).withColumn("_times", times).where("_times > 0")
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), "_times")).alias("_copy")).drop("_copy")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    out = mix(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("n").alias("n_tokens"), *(F.col(f"p{i}").alias(f"p_{x}") for i, x in enumerate(DOMAINS)), "rate")
