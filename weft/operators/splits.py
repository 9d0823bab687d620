"""Splits, targets, negatives and neighbours (survey section 2.11). Draws are orders of MD5, the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.closure import staged
from weft.operators.rank import global_rank, running_sums


#: So many taken ids of a source and type are kept beside each of its edges; more are joined.
INLINE = 1024


def draw(*parts: Column) -> Column:
    """A number below 2^32 from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def timed(edges: DataFrame) -> DataFrame:
    """T01."""
    return edges.where("time is not null")


def temporal_cut(edges: DataFrame, test_share: float) -> DataFrame:
    """T02. One row: the least time up to which there are (1 - test_share) of the edges."""
    n = staged(edges.groupBy("time").agg(F.count("*").alias("n")))
    total = n.agg(F.sum("n").alias("total"))
    x = running_sums(n, [], "time", {"up": F.col("n")}).join(F.broadcast(total))  # total has one row
    return x.where(F.col("up") >= (1 - test_share) * F.col("total")).agg(F.min("time").alias("cut"))


def temporal_split(edges: DataFrame, test_share: float) -> DataFrame:
    """T02. edges with split: train up to the cut, else test."""
    cut = F.broadcast(temporal_cut(edges, test_share))  # one row
    return edges.join(cut).withColumn("split", F.when(F.col("time") <= F.col("cut"), "train").otherwise("test")).drop("cut")


def node_parts(nodes: DataFrame, seed: int, n_val: int, n_test: int) -> DataFrame:
    """T04. label, part: the first n_test of the drawn order are test, the next n_val val, the others train. Only as many
    rows as the two parts hold are brought together."""
    d = nodes.select("label", draw(F.lit(seed), F.col("label")).alias("_d"))
    first = d.orderBy("_d", "label").limit(n_test + n_val).withColumn("_r", F.row_number().over(Window.orderBy("_d", "label")))
    picked = first.select("label", F.when(F.col("_r") <= n_test, "test").otherwise("val").alias("part"))
    return nodes.select("label").join(picked, "label", "left").select("label", F.coalesce("part", F.lit("train")).alias("part"))


def node_disjoint(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """T04. Edges whose ends share a part, with split; others are left out."""
    a, b = parts.select(F.col("label").alias("src"), F.col("part").alias("split")), parts.select(F.col("label").alias("dst"), F.col("part").alias("_p"))
    return edges.join(a, "src").join(b, "dst").where(F.col("split") == F.col("_p")).drop("_p")


def bridges(edges: DataFrame, unseen: DataFrame) -> DataFrame:
    """T05. Edges with split: train where neither end is unseen, test where just one is; the rest is left out."""
    u = unseen.select("label").distinct()
    a, b = u.select(F.col("label").alias("src"), F.lit(True).alias("_a")), u.select(F.col("label").alias("dst"), F.lit(True).alias("_b"))
    n = F.coalesce("_a", F.lit(False)).cast("int") + F.coalesce("_b", F.lit(False)).cast("int")
    return edges.join(a, "src", "left").join(b, "dst", "left").withColumn("_n", n).where("_n < 2").withColumn("split", F.when(F.col("_n") == 0, "train").otherwise("test")).drop("_a", "_b", "_n")


def order_bins(edges: DataFrame, bins: int) -> DataFrame:
    """T06. bin: how many of the train times' quantiles are at or below an edge's time."""
    q = edges.where("split = 'train'").agg(F.percentile("time", F.lit([i / bins for i in range(1, bins)])).alias("_q"))
    return edges.join(F.broadcast(q)).withColumn("bin", F.size(F.filter("_q", lambda x: x <= F.col("time")))).drop("_q")  # q has one row


def order_targets(edges: DataFrame) -> DataFrame:
    """T07. min_max and log_min_max of the time, where a span under 1 counts as 1, and rank: the position among all edges
    (by time, then edge) over the greatest one."""
    m = edges.agg(F.min("time").alias("_lo"), F.max("time").alias("_hi"), F.count("*").alias("_n"))
    x = edges.join(F.broadcast(m))  # m has one row
    t, span = F.col("time") - F.col("_lo"), F.col("_hi") - F.col("_lo")
    top = F.log1p(span.cast("double"))
    x = x.withColumn("min_max", t / F.greatest(span, F.lit(1))).withColumn("log_min_max", F.log1p(t.cast("double")) / F.greatest(top, F.lit(1.0)))
    x = global_rank(x, F.col("time"), [F.col("edge")], "_r")
    return x.withColumn("rank", F.col("_r") / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_lo", "_hi", "_n", "_r")


def uniform_negatives(edges: DataFrame, nodes: DataFrame, n_nodes: int, k: int, seed: int) -> DataFrame:
    """T08. k nodes for each edge by drawn dense ids. nodes: id, label."""
    x = edges.select("edge", "src", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    x = x.withColumn("id", F.pmod(draw(F.lit(seed), F.col("edge"), F.col("i")), F.lit(n_nodes)))
    return x.join(nodes, "id").select("edge", "i", F.col("label").alias("negative"))


def typed_negatives(edges: DataFrame, nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """T09. As uniform_negatives, but of the type of the edge's end. nodes: label, type, id dense in its type; edges: edge, dst."""
    sizes = nodes.groupBy("type").agg(F.count("*").alias("n"))
    x = edges.join(nodes.select(F.col("label").alias("dst"), "type"), "dst").join(sizes, "type")
    own = [c for c in ("edge", "src") if c in edges.columns]
    x = x.select(*own, "type", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    x = x.withColumn("id", F.pmod(draw(F.lit(seed), F.col("edge"), F.col("i")), F.col("n")))
    return x.join(nodes, ["type", "id"]).select(*own, "i", F.col("label").alias("negative"))


def partner_free_negatives(edges: DataFrame, train: DataFrame, nodes: DataFrame, k: int, seed: int, tries: int = 16) -> DataFrame:
    """T10. k nodes of the end's type that are neither the end, nor the source, nor one of its train partners: distinct ones
    where the pool has k, with replacement where it is smaller, any nodes where it is empty. Rows of one edge and source count as one.

    The first k of tries x k drawn candidates are taken; edges that get fewer draw anew from their whole pool (_from_pool). An edge
    draws beside the list of its source's taken ids until it has k, so candidates are no rows. Sources with more than INLINE
    taken ids of a type and edges with ends of several types draw by joins (_by_joins), with the same result.
    """
    own = edges.select("edge", "src", "dst").where("src is not null")
    partners = train.select("src", F.col("dst").alias("negative")).distinct()
    by_label = nodes.select("label", "type", "id")
    sizes = nodes.groupBy("type").agg(F.count("*").alias("n"))
    itself = own.select("src").distinct().select("src", F.col("src").alias("negative"))
    taken = partners.unionByName(itself).join(by_label.withColumnRenamed("label", "negative"), "negative").select("src", "type", "id").distinct()
    first = Window.partitionBy("src", "type").orderBy("id")
    taken = taken.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= INLINE + 1).groupBy("src", "type").agg(F.collect_list("id").alias("taken"))
    x = own.join(by_label.withColumnRenamed("label", "dst"), "dst", "left").repartition("edge", "src").groupBy("edge", "src")
    x = x.agg(F.min("dst").alias("dst"), F.collect_set("id").alias("ends"), F.min("type").alias("type"), F.max("type").alias("_t"))
    x = x.join(F.broadcast(sizes), "type", "left").join(taken, ["src", "type"], "left").withColumn("taken", F.coalesce("taken", F.slice("ends", 1, 0)))  # sizes has a row for each type
    rest = F.coalesce((F.col("type") != F.col("_t")) | (F.size("taken") > INLINE), F.lit(False))

    def take(acc, i):
        """acc with the i-th draw behind it, where that is free and acc not full; a draw is made only if it is needed."""
        free = lambda c: ~F.array_contains("taken", c) & ~F.array_contains("ends", c) & ~F.array_contains(acc, c)
        drawn = F.array(F.pmod(draw(F.lit(seed), F.col("edge"), i), F.col("n")))
        return F.when(F.size(acc) < k, F.transform(drawn, lambda c: F.when(free(c), F.concat(acc, F.array(c))).otherwise(acc))[0]).otherwise(acc)

    found = F.aggregate(F.sequence(F.lit(0), F.lit(k * tries - 1)), F.array().cast("array<bigint>"), take)
    x = staged(x.select("edge", "src", "dst", "type", F.when(~rest, found).alias("found")))
    kept = x.where(F.size("found") == k).select("edge", "type", F.explode("found").alias("id")).join(by_label, ["type", "id"]).select("edge", F.col("label").alias("negative"))
    short, hard = x.where(F.size("found") < k).select("edge", "src", "dst"), x.where("found is null").select("edge", "src")
    if hard.limit(1).count():
        more, few = _by_joins(own.join(hard, ["edge", "src"], "left_semi"), partners, nodes, k, seed, tries)
        kept, short = kept.unionByName(more), short.unionByName(few)
    return kept.unionByName(_from_pool(short, partners, nodes, k, seed, k * tries)) if short.limit(1).count() else kept


def _by_joins(own: DataFrame, partners: DataFrame, nodes: DataFrame, k: int, seed: int, tries: int) -> tuple[DataFrame, DataFrame]:
    """edge, negative of the edges that get k of their draws; and the others (edge, src, dst). Every draw is a row."""
    some = typed_negatives(own, nodes, k * tries, seed).where("negative <> src")
    free = some.join(partners, ["src", "negative"], "left_anti").join(own.withColumnRenamed("dst", "negative"), ["edge", "src", "negative"], "left_anti")
    first = free.groupBy("edge", "src", "negative").agg(F.min("i").alias("i"))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("edge", "src").orderBy("i", "negative"))).where(F.col("r") <= k)
    enough = first.where(F.col("r") == k).select("edge", "src")
    short = own.join(enough, ["edge", "src"], "left_anti").groupBy("edge", "src").agg(F.min("dst").alias("dst"))
    return first.join(enough, ["edge", "src"], "left_semi").select("edge", "negative"), short


def _from_pool(edges: DataFrame, partners: DataFrame, nodes: DataFrame, k: int, seed: int, start: int) -> DataFrame:
    """k draws for each edge from the free nodes of the end's type, by rank among the free ids.

    A source's taken ids of a type are numbered; an id has as many free ids below it as it exceeds its number. Ranks and
    taken ids meet in running counts, so neither pools nor products of edges and partners are made.
    """
    by_label = nodes.select("label", "type", "id")
    sizes = nodes.groupBy("type").agg(F.count("*").alias("n"))
    e = edges.join(by_label.select(F.col("label").alias("dst"), "type", F.col("id").alias("v")), "dst").join(sizes, "type")
    sources = e.select("src").distinct()
    taken = partners.join(sources, "src", "left_semi").unionByName(sources.select("src", F.col("src").alias("negative"))).distinct()
    taken = taken.join(by_label.withColumnRenamed("label", "negative"), "negative").select("src", "type", F.col("id").alias("at"))
    taken = taken.withColumn("below", F.col("at") - F.row_number().over(Window.partitionBy("src", "type").orderBy("at")) + 1)

    def counted(points: DataFrame, at: str) -> DataFrame:
        """points: src, type, at. Adds the number of taken ids whose column `at` is at most that."""
        marks = points.distinct().withColumn("_x", F.lit(0)).unionByName(taken.select("src", "type", F.col(at).alias("at"), F.lit(1).alias("_x")))
        w = Window.partitionBy("src", "type").orderBy("at", F.desc("_x")).rowsBetween(Window.unboundedPreceding, 0)
        return marks.withColumn("c", F.sum("_x").over(w)).where("_x = 0").drop("_x")

    m = taken.groupBy("src", "type").agg(F.count("*").alias("m"))
    e = e.join(m, ["src", "type"], "left").join(counted(e.select("src", "type", F.col("v").alias("at")), "at").withColumnRenamed("at", "v"), ["src", "type", "v"])
    e = e.join(taken.select("src", "type", F.col("at").alias("v"), F.lit(True).alias("_t")), ["src", "type", "v"], "left")
    open_end = F.col("_t").isNull()
    e = e.withColumn("hole", F.when(open_end, F.col("v") - F.col("c"))).withColumn("p", F.col("n") - F.coalesce("m", F.lit(0)) - open_end.cast("int"))

    d = lambda i: draw(F.lit(seed), F.col("edge"), F.lit(start) + i)

    def floyd(acc, i):
        j = F.col("p") - k + i
        t = F.pmod(d(i), j + 1)
        return F.concat(acc, F.array(F.when(F.array_contains(acc, t), j).otherwise(t)))

    each = F.sequence(F.lit(0), F.lit(k - 1))
    ranks = F.when(F.col("p") >= k, F.aggregate(each, F.array().cast("array<bigint>"), floyd)).otherwise(F.transform(each, lambda i: F.pmod(d(i), F.col("p"))))
    x = e.where("p > 0").withColumn("f", F.explode(ranks))
    x = x.select("edge", "src", "type", (F.col("f") + F.coalesce((F.col("f") >= F.col("hole")).cast("int"), F.lit(0))).alias("at"))
    x = x.join(counted(x.select("src", "type", "at"), "below"), ["src", "type", "at"]).select("edge", "type", (F.col("at") + F.col("c")).alias("id"))
    found = x.join(by_label, ["type", "id"]).select("edge", F.col("label").alias("negative"))

    starts = sizes.withColumn("lo", F.sum("n").over(Window.orderBy("type").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))  # one row for each type
    total = sizes.agg(F.sum("n").alias("_all"))
    y = e.where("p <= 0").select("edge", F.explode(F.transform(each, d)).alias("u")).join(F.broadcast(total)).withColumn("u", F.pmod("u", "_all"))  # one row
    y = y.join(F.broadcast(starts), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("lo") + F.col("n"))).select("edge", "type", (F.col("u") - F.col("lo")).alias("id"))
    return found.unionByName(y.join(by_label, ["type", "id"]).select("edge", F.col("label").alias("negative")))


def recent_in(edges: DataFrame, k: int) -> DataFrame:
    """T11. The k latest incoming edges of each node by (time, src, type)."""
    w = Window.partitionBy("dst").orderBy(F.desc("time"), F.desc("src"), F.desc("type"))
    return edges.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("dst", "pos", "src", "time", "type")


def recent_any(edges: DataFrame, k: int) -> DataFrame:
    """T12. The k latest edges at each node, whichever way, by (time, type, other)."""
    x = edges.select("time", "type", F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))))
    w = Window.partitionBy("node").orderBy(F.desc("time"), F.desc("type"), F.desc("other"))
    return x.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def causal(queries: DataFrame, neighbours: DataFrame, k: int | None = None) -> DataFrame:
    """T13. Neighbours strictly before the query's time. On a table cut to k before (parity), or, with k, cut after.

    With k, neighbours are numbered in order of time and counted up to each query's time, and only the last k numbers are
    joined: a node's queries never meet all of its neighbours.
    """
    n = neighbours.withColumnRenamed("time", "_t")
    if k is None:
        x = queries.join(n, queries["node"] == n["dst"]).where("_t < time")
        return x.withColumn("delta", F.greatest(F.col("time") - F.col("_t"), F.lit(0))).drop("dst")
    n = n.where("_t is not null").withColumn("_p", F.row_number().over(Window.partitionBy("dst").orderBy("_t", "src", "type")))
    at = queries.select("node", "time").where("time is not null").distinct().withColumn("_n", F.lit(0))
    marks = at.unionByName(n.select(F.col("dst").alias("node"), F.col("_t").alias("time"), F.lit(1).alias("_n")))
    so_far = Window.partitionBy("node").orderBy("time", "_n").rowsBetween(Window.unboundedPreceding, 0)
    upto = marks.withColumn("_c", F.sum("_n").over(so_far)).where("_n = 0 and _c > 0").select("node", "time", "_c")
    x = queries.join(upto, ["node", "time"]).withColumn("_p", F.explode(F.sequence(F.greatest(F.col("_c") - (k - 1), F.lit(1)), F.col("_c")))).select(*queries.columns, F.col("_p").cast("int").alias("_p"))
    x = x.join(n.withColumnRenamed("dst", "node"), ["node", "_p"]).drop("_p")
    x = x.withColumn("delta", F.greatest(F.col("time") - F.col("_t"), F.lit(0)))
    w = Window.partitionBy("query").orderBy(F.desc("_t"), F.desc("src"), F.desc("type"))
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def normalised(edges: DataFrame) -> DataFrame:
    """T14. time over the greatest train time (1 where that is 0)."""
    m = edges.where("split = 'train'").agg(F.max("time").alias("_m"))
    return edges.join(F.broadcast(m)).withColumn("norm_time", F.col("time") / F.when(F.col("_m") == 0, 1).otherwise(F.col("_m"))).drop("_m")  # one row


def cold_start(edges: DataFrame) -> DataFrame:
    """T16. Test edges with both, one or no end in train."""
    seen = edges.where("split = 'train'").select(F.explode(F.array("src", "dst")).alias("label")).distinct()
    a, b = seen.select(F.col("label").alias("src"), F.lit(1).alias("_a")), seen.select(F.col("label").alias("dst"), F.lit(1).alias("_b"))
    n = F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))
    x = edges.where("split = 'test'").join(a, "src", "left").join(b, "dst", "left")
    return x.agg(F.count_if(n == 2).alias("both"), F.count_if(n == 1).alias("one"), F.count_if(n == 0).alias("neither"))


def check_assignment(assigned: DataFrame, nodes: DataFrame) -> None:
    """T17, S27. Raise for labels that are no nodes and for labels in two parts."""
    strange = assigned.join(nodes, "label", "left_anti").limit(5).collect()
    if strange:
        raise ValueError(f"not nodes: {[r.label for r in strange]}")
    twice = assigned.groupBy("label").agg(F.countDistinct("part").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"in two parts: {[r.label for r in twice]}")


def replay_negatives(events: DataFrame, train_nodes: DataFrame, n_nodes: int, k: int, seed: int) -> DataFrame:
    """T15. k distinct train nodes for each event, neither end of it (all there are where the pool is smaller), in place of
    the end that is in train (the target where both are). events: edge, src, dst; train_nodes: id (dense), label.

    Ranks among the free nodes are drawn without repetition by Floyd's method; the ids of the ends, two at most, are stepped over.
    """
    t = train_nodes.select("label", "id")
    x = events.join(t.select(F.col("label").alias("dst"), F.col("id").alias("_d")), "dst", "left").join(t.select(F.col("label").alias("src"), F.col("id").alias("_s")), "src", "left")
    x = x.where("_d is not null or _s is not null").withColumn("side", F.when(F.col("_d").isNotNull(), "dst").otherwise("src"))
    lo, hi = F.least("_d", "_s"), F.greatest("_d", "_s")
    x = x.withColumn("_lo", lo).withColumn("_hi", F.when(hi > lo, hi)).withColumn("_p", F.lit(n_nodes).cast("long") - 1 - F.col("_hi").isNotNull().cast("int"))

    def floyd(acc, i):
        j = F.greatest(F.col("_p") - k, F.lit(0)) + i
        u = F.pmod(draw(F.lit(seed), F.col("edge"), i), j + 1)
        return F.concat(acc, F.array(F.when(F.array_contains(acc, u), j).otherwise(u)))

    each = F.when(F.col("_p") > 0, F.sequence(F.lit(0).cast("long"), F.least(F.col("_p"), F.lit(k)) - 1)).otherwise(F.array().cast("array<bigint>"))
    drawn = x.select("edge", "side", "_lo", "_hi", F.explode(F.aggregate(each, F.array().cast("array<bigint>"), floyd)).alias("id"))
    step = drawn.withColumn("id", F.col("id") + (F.col("id") >= F.col("_lo")).cast("int"))
    step = step.withColumn("id", F.col("id") + F.coalesce((F.col("id") >= F.col("_hi")).cast("int"), F.lit(0)))
    return step.join(t, "id").select("edge", "side", F.col("label").alias("negative"))
