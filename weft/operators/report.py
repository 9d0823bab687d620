"""Whole reports of graphs: the profile of one, the table of many, the histogram of chains (survey section 2.10).

edges: src, dst, type, time, pathway, local_order; types: label, type, once each. An edge with a null end is left out. A label
without a type reads unknown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.analytics import component_sizes, degrees, strong_cores, trim
from weft.operators.closure import staged

BINS = 24


def _chains(edges: DataFrame) -> DataFrame:
    known = edges.where("pathway is not null and local_order is not null")
    return known.groupBy("pathway").agg((F.max("local_order") + 1).cast("long").alias("length"))


def _typed(nodes: DataFrame, types: DataFrame | Column) -> DataFrame:
    return nodes.withColumn("type", types) if isinstance(types, Column) else nodes.join(types.select("label", "type"), "label", "left")


def profile(edges: DataFrame, types: DataFrame | Column, hubs: int = 10, name: Column | None = None) -> DataFrame:
    """A01. item, key, value: what summary() leaves out. Items: node_type and edge_type (counts by type), hub (degree of the
    `hubs` nodes with most edges, ties by label), chain (pathways, min, median, max of the steps), orphan_edges (edges
    without a pathway or step), components (weak, strong) and dag (1 or 0). An empty graph has no types and no hubs, chains of
    0, and is a dag. types may be a function of label; name is what is shown of a label, itself if not given.

    Edges are written once, and figures of edges and of nodes are each taken in one pass over them.
    """
    e = staged(edges.select("src", "dst", "type", "pathway", "local_order").dropna(subset=["src", "dst"]))
    row = lambda item, key, value: [F.lit(item).alias("item"), key.cast("string").alias("key"), value.cast("double").alias("value")]
    n = F.count("*")
    d = staged(degrees(e).select("*", (F.col("label") if name is None else name).cast("string").alias("name")))
    typed = _typed(d, types).groupBy(F.coalesce("type", F.lit("unknown")).alias("k")).agg(n.alias("n"))
    orphan, loop = F.col("pathway").isNull() | F.col("local_order").isNull(), F.col("src") == F.col("dst")
    by = staged(e.groupBy("type", "pathway").agg(n.alias("n"), F.max("local_order").alias("local_order"), F.count_if(orphan).alias("orphans"), F.count_if(loop).alias("loops")))
    parts = [
        typed.select(*row("node_type", F.col("k"), F.col("n"))),
        by.groupBy(F.coalesce("type", F.lit("unknown")).alias("k")).agg(F.sum("n").alias("n")).select(*row("edge_type", F.col("k"), F.col("n"))),
        d.orderBy(F.desc("degree"), "name").limit(hubs).select(*row("hub", F.col("name"), F.col("degree"))),
        by.agg(F.coalesce(F.sum("orphans"), F.lit(0)).alias("n")).select(*row("orphan_edges", F.lit(""), F.col("n"))),
    ]
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    c = _chains(by).agg(n.cast("double").alias("pathways"), zero(F.min("length")).alias("min"), zero(F.percentile("length", F.lit(0.5))).alias("median"), zero(F.max("length")).alias("max"))
    parts.append(c.select(F.inline(F.array(*[F.struct(*row("chain", F.lit(k), F.col(k))) for k in ("pathways", "min", "median", "max")]))))
    parts.append(component_sizes(e).agg(n.alias("n")).select(*row("components", F.lit("weak"), F.col("n"))))
    rest = trim(e, ends=d)  # each node that is left leads to another, so there is a cycle if any is
    cores = strong_cores(rest)
    strong = d.agg(n.alias("n"))
    if cores is not None:
        strong = strong.unionByName(cores.agg((F.countDistinct("component") - n).alias("n"))).agg(F.sum("n").alias("n"))
    parts.append(strong.select(*row("components", F.lit("strong"), F.col("n"))))
    acyclic = cores is None and not by.where("loops > 0").limit(1).count()
    parts.append(e.limit(0).agg(F.lit(float(acyclic)).alias("n")).select(*row("dag", F.lit(""), F.col("n"))))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def table(edges: DataFrame, types: DataFrame) -> DataFrame:
    """A02. One row for each graph, that is each pathway: fifteen figures. All graphs are worked on at once, as one graph whose
    nodes carry their pathway's name. A null pathway is a graph of its own, named by the empty text. The tail is the share of
    nodes first seen after 0.8 of the last first-seen time (taken as 1 where it is 0); nodes never seen at a time do not count
    in it. Shares are in percent."""
    g = F.coalesce("pathway", F.lit(""))
    mark = F.concat(F.length(g).cast("string"), F.lit(":"), g)
    e = edges.dropna(subset=["src", "dst"]).select(F.concat(mark, F.col("src").cast("string")).alias("src"), F.concat(mark, F.col("dst").cast("string")).alias("dst"), "type", "time")
    before = lambda c: F.substring_index(c, ":", 1)
    graph = lambda c: F.substr(F.col(c), F.length(before(c)) + 2, before(c).cast("int"))
    label = F.substr(F.col("node"), F.length(before("node")) + 2 + F.length("pathway")).alias("label")
    named = types.select(F.col("label").cast("string").alias("label"), "type")
    return table_of_marked(e, graph, lambda nodes: _typed(nodes.withColumn("label", label), named))


def table_of_marked(edges: DataFrame, graph: Callable[[str], Column], typed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """table() of edges src, dst, type, time whose ends tell what graph they belong to: graph(c) is that of the node in column c.
    typed gives nodes (node, pathway) their type. Edges are written once."""
    e = staged(edges.select("src", "dst", "type", "time"))
    share = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    is_reaction = F.coalesce(F.col("type") == "reaction", F.lit(False))
    n = e.groupBy(graph("src").alias("pathway"), "time").agg(F.count("*").alias("n"), F.count_if(is_reaction).alias("r"), F.count_if(F.col("src") == F.col("dst")).alias("l"))
    of_edges = n.groupBy("pathway").agg(F.sum("n").alias("edges"), F.count("time").alias("ranks"), F.round(100 * (F.sum("r").cast("double") / F.sum("n")), 6).alias("pct_reaction"), F.sum("l").alias("_loops"))
    ends = e.select("time", F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))))
    nodes = staged(ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("o").alias("n_out"), F.min("time").alias("seen"))).withColumn("pathway", graph("node"))
    last = nodes.groupBy("pathway").agg(F.max("seen").alias("_l"))
    late = F.col("seen") > 0.8 * F.when(F.col("_l") == 0, 1).otherwise(F.col("_l"))
    is_type = lambda t: share(F.coalesce(F.col("type") == t, F.lit(False))).alias(f"pct_{t}")
    of_nodes = typed(nodes).join(last, "pathway").groupBy("pathway").agg(
        F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("degree_avg"), F.max("degree").alias("degree_max"), share(late).alias("tail_pct"),
        is_type("protein"), is_type("complex"), is_type("small_molecule"),
    )
    of_components = component_sizes(e).groupBy(graph("component").alias("pathway")).agg(F.count("*").alias("wccs"), F.max("size").alias("_largest"), F.count_if(F.col("size") == 1).alias("isolated"))
    rest = trim(e, ends=nodes.select(F.col("node").alias("label"), "n_out", (F.col("degree") - F.col("n_out")).alias("n_in")))
    cyclic = rest.select(graph("src").alias("pathway")).distinct().withColumn("_cycle", F.lit(True))
    x = of_nodes.join(of_edges, "pathway").join(of_components, "pathway").join(cyclic, "pathway", "left")
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return x.select(
        "pathway", "nodes", "edges", F.when(pairs > 0, F.round(F.col("edges") / pairs, 9)).otherwise(0.0).alias("density"), "degree_avg", "degree_max", (F.col("_cycle").isNull() & (F.col("_loops") == 0)).alias("is_dag"),
        "wccs", F.round(100 * F.col("_largest") / F.col("nodes"), 6).alias("largest_wcc_pct"), "isolated", "ranks", "tail_pct", "pct_protein", "pct_complex", "pct_small_molecule", "pct_reaction",
    )


def chain_histogram(edges: DataFrame) -> DataFrame:
    """A08. bin, low, high, pathways, median: lengths of chains in 24 bins, equal on a log scale from 1 to one over the longest, or in
    two bins around 1 and 2 where none is longer than 1. Empty without a chain. The last bin holds its upper end."""
    c = _chains(edges)
    top = c.agg(F.max("length").alias("_top"), F.percentile("length", F.lit(0.5)).alias("median")).where("_top is not null")
    step = F.log10(F.col("_top") + 1.0) / BINS
    ends = F.when(F.col("_top") <= 1, F.array(*map(F.lit, (0.5, 1.5, 2.5)))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda i: F.pow(F.lit(10.0), i * step)))
    top = top.select("median", ends.alias("_ends"))  # one row
    grid = top.select("median", F.posexplode("_ends").alias("bin", "low"), "_ends").where(F.col("bin") < F.size("_ends") - 1).select("bin", "low", F.col("_ends")[F.col("bin") + 1].alias("high"), "median")
    at = F.least(F.size(F.filter("_ends", lambda x: x <= F.col("length"))), F.size("_ends") - 1) - 1
    n = c.join(F.broadcast(top)).groupBy(at.alias("bin")).agg(F.count("*").alias("pathways"))
    return grid.join(n, "bin", "left").select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.coalesce("pathways", F.lit(0)).alias("pathways"), "median")
