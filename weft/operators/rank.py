"""Ranks over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def _bucketed(df: DataFrame, by: Column, buckets: int) -> DataFrame:
    """df with _bucket: the part between two quantiles of `by` (a number) that a row lies in; equal values share one, nulls come last."""
    x = df.withColumn("_by", by.cast("double"))
    cuts = sorted(set(x.approxQuantile("_by", [i / buckets for i in range(1, buckets)], 0.5 / buckets)))
    if not cuts:
        return x.withColumn("_bucket", F.lit(0)).drop("_by")
    bucket = F.when(F.col("_by").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_by"))))
    return x.withColumn("_bucket", bucket).drop("_by")


def running_sums(df: DataFrame, groups: list[str], by: str, sums: dict[str, Column], inclusive: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """df with, for each entry of `sums`, the sum of its column over the rows of the same groups at or below (below, if not
    inclusive) the row's `by`, a number or date. Rows of one group must differ in `by`: sum over equal values first.

    Two levels: the order is cut into quantile buckets, buckets are summed, and a window runs within each group's bucket; so
    no window holds more than a bucket, however large a group is. The second window has at most buckets + 1 rows a group.
    """
    x = _bucketed(df, _number(df, by), buckets)
    keys = [*groups, "_bucket"]
    up = Window.partitionBy(*groups, F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"_t_{k}").over(up), F.lit(0)).alias(f"_b_{k}") for k in sums])
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    here = x.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_h_{k}") for k, c in sums.items()])
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = here.join(before, cond)
    return both.select(*df.columns, *[(F.col(f"_h_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])


def _number(df: DataFrame, by: str) -> Column:
    kind = dict(df.dtypes)[by]
    return F.unix_micros(F.col(by).cast("timestamp")) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(by)


def global_rank(df: DataFrame, by: Column, ties: list[Column], name: str, buckets: int = BUCKETS) -> DataFrame:
    """df with the rank from 0 in the order of `by` (a number; nulls last), then `ties`.

    Quantiles of `by` cut the rows into buckets; the buckets before a row's own are counted (at most `buckets` rows), the
    rest is a window within its bucket.
    """
    x = _bucketed(df.withColumn("_order", by.cast("double")), F.col("_order"), buckets)
    before, at = {}, 0
    for b, n in sorted(x.groupBy("_bucket").count().collect()):
        before[b], at = at, at + n
    offset = F.create_map(*[F.lit(v).cast("long") for kv in before.items() for v in kv]) if before else F.lit(None)
    w = Window.partitionBy("_bucket").orderBy(F.col("_order").asc_nulls_last(), *ties)
    rank = F.row_number().over(w) - 1 + (offset[F.col("_bucket").cast("long")] if before else F.lit(0))
    return x.withColumn(name, rank.cast("long")).drop("_order", "_bucket")


def mid_rank(df: DataFrame, value: str, name: str, groups: list[str] | None = None) -> DataFrame:
    """df with the average rank (from 1) of `value`: positions are summed over distinct values, so ties cost nothing."""
    groups = groups or []
    sizes = df.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    up = running_sums(sizes, groups, value, {"_up": F.col("_n")})
    ranks = up.select(*groups, value, (F.col("_up") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*groups, value])
