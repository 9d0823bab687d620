"""Graph statistics, growth series and component reports (survey section 2.10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import forest
from weft.operators.closure import staged
from weft.operators.edges import endpoints
from weft.operators.rank import running_sums


def first_seen(edges: DataFrame) -> DataFrame:
    """A03. label, first_time."""
    return endpoints(edges).groupBy("label").agg(F.min("time").alias("first_time"))


def recruitment_tail(edges: DataFrame, share: float = 0.8) -> DataFrame:
    """A04. Share of nodes first seen after `share` of the last first-seen time (taken as 1 where it is 0)."""
    seen = staged(first_seen(edges))  # read twice
    top = seen.agg(F.max("first_time").alias("_t"))
    late = F.col("first_time") > share * F.when(F.col("_t") == 0, 1).otherwise(F.col("_t"))
    return seen.join(F.broadcast(top)).agg(F.round(F.avg(late.cast("double")), 6).alias("tail"))  # top has one row


def growth(edges: DataFrame) -> DataFrame:
    """A05. Edges of each type up to each time that has any."""
    n = edges.groupBy("type", "time").agg(F.count("*").alias("n"))
    return running_sums(staged(n), ["type"], "time", {"total": F.col("n")}).select("type", "time", "total")


def recruitment(edges: DataFrame) -> DataFrame:
    """A06. New nodes at each time and all so far."""
    n = first_seen(edges).groupBy(F.col("first_time").alias("time")).agg(F.count("*").alias("new"))
    return running_sums(staged(n), [], "time", {"total": F.col("new")})


def growth_bands(edges: DataFrame, max_step: int | None = None) -> DataFrame:
    """A07. For steps 0 to the greatest local order (or max_step, if less) the median and quartiles over pathways of edges up to that local order."""
    n = staged(edges.groupBy("pathway", F.col("local_order").cast("int").alias("step")).agg(F.count("*").alias("n")))
    top = F.max("step")
    last = n.agg((top if max_step is None else F.least(top, F.lit(max_step))).alias("_last"))
    grid = n.select("pathway").distinct().join(F.broadcast(last)).select("pathway", F.explode(F.sequence(F.lit(0), "_last")).alias("step"))  # last has one row
    w = Window.partitionBy("pathway").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    total = grid.join(n, ["pathway", "step"], "left").select("step", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("total"))
    q = lambda p: F.round(F.percentile("total", F.lit(p)), 4)
    return total.groupBy("step").agg(q(0.25).alias("low"), q(0.5).alias("median"), q(0.75).alias("high"))


def chain_lengths(edges: DataFrame) -> DataFrame:
    """A08. Longest chain of each pathway."""
    return edges.groupBy("pathway").agg((F.max("local_order") + 1).alias("length"))


def pathway_table(edges: DataFrame) -> DataFrame:
    """A02. Of each pathway its edges, last time, chain, share of reaction edges and nodes, in one pass: an edge counts with its source."""
    zero, none = F.lit(0), lambda kind: F.lit(None).cast(kind)
    kind = F.col("type") == "reaction"
    own = F.struct(F.col("src").alias("label"), F.lit(1).alias("e"), kind.cast("int").alias("r"), kind.isNotNull().cast("int").alias("k"), F.col("time").cast("long").alias("t"), F.col("local_order").cast("long").alias("o"))
    far = F.struct(F.col("dst").alias("label"), zero.alias("e"), zero.alias("r"), zero.alias("k"), none("long").alias("t"), none("long").alias("o"))
    x = edges.where("pathway is not null").select("pathway", F.inline(F.array(own, far)))
    n = x.groupBy("pathway", "label").agg(F.sum("e").alias("e"), F.sum("r").alias("r"), F.sum("k").alias("k"), F.max("t").alias("t"), F.max("o").alias("o"))
    share = F.round(F.try_divide(F.sum("r"), F.sum("k")), 6)
    return n.groupBy("pathway").agg(F.sum("e").alias("n_edges"), F.max("t").alias("last_time"), (F.max("o") + 1).alias("chain"), share.alias("reaction_share"), F.count("label").alias("n_nodes"))


def degrees(edges: DataFrame) -> DataFrame:
    """label, n_out, n_in, degree."""
    x = edges.select(F.inline(F.array(F.struct(F.col("src").alias("label"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("label"), F.lit(0).alias("o")))))
    return x.groupBy("label").agg(F.sum("o").alias("n_out"), F.sum(1 - F.col("o")).alias("n_in"), F.count("*").alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    """A12. degree, nodes, and the share of nodes with that degree or more."""
    n = degrees(edges).groupBy("degree").agg(F.count("*").alias("nodes"))
    w = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each degree
    total = F.sum("nodes").over(Window.partitionBy(F.lit(1)))
    return n.select("degree", "nodes", F.round(F.sum("nodes").over(w) / total, 6).alias("ccdf"))


def clipped(edges: DataFrame, types: DataFrame | Column, q: float = 0.99) -> DataFrame:
    """A13. By node type: in and out degree limits at the q-th percentile, and nodes beyond either. types: label, type, or the type as a
    function of label."""
    d = degrees(edges)
    d = staged(d.withColumn("type", types) if isinstance(types, Column) else d.join(types, "label"))  # read twice
    lim = d.groupBy("type").agg(F.percentile("n_in", F.lit(q)).alias("in_limit"), F.percentile("n_out", F.lit(q)).alias("out_limit"))
    return d.join(lim, "type").groupBy("type").agg(F.round(F.max("in_limit"), 4).alias("in_limit"), F.round(F.max("out_limit"), 4).alias("out_limit"), F.count_if((F.col("n_in") > F.col("in_limit")) | (F.col("n_out") > F.col("out_limit"))).alias("clipped"))


def breakdown(x: DataFrame, by: str) -> DataFrame:
    """A14. Count and share of each value; null reads unknown."""
    n = x.groupBy(F.coalesce(by, F.lit("unknown")).alias(by)).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def top(x: DataFrame, by: str, n: int) -> DataFrame:
    """A15, A16, A18. The n most frequent values, ties by value."""
    return x.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias(by)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def reaction_sizes(edges: DataFrame) -> DataFrame:
    """A17. Distinct nodes of each (pathway, local_order) over reaction edges, counted by size."""
    x = edges.where("type = 'reaction'").select("pathway", "local_order", F.explode(F.array("src", "dst")).alias("label"))
    return x.groupBy("pathway", "local_order").agg(F.countDistinct("label").alias("size")).groupBy("size").agg(F.count("*").alias("reactions"))


def summary(edges: DataFrame) -> DataFrame:
    """A01. One row: nodes, edges, density, degree figures, ranks used."""
    d = degrees(edges).agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("degree_avg"), F.max("degree").alias("degree_max"), F.round(F.avg("n_in"), 6).alias("in_avg"), F.max_by("label", F.struct("degree", "label")).alias("hub"))
    e = edges.agg(F.count("*").alias("edges"), F.countDistinct("time").alias("ranks"))
    both = d.join(F.broadcast(e))  # one row each
    return both.withColumn("density", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9))


def weak_components(edges: DataFrame) -> DataFrame:
    """A09. label, component (its least label). Labels that are whole numbers are first hung in forests (forest.hung())."""
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u is not null")
    if e.schema["u"].dataType.typeName() in ("byte", "short", "integer", "long"):
        kind = e.schema["u"].dataType
        at, tops = _hung_components(e)
        found = at.join(tops, "v", "left").select("u", F.coalesce("c", "v").alias("c"))
        return found.select(*[F.col(c).cast(kind).alias(n) for c, n in (("u", "label"), ("c", "component"))])
    e = staged(e.distinct())
    labels = e.select(F.explode(F.array("u", "v")).alias("label")).distinct()
    stars = _stars(e.where("u <> v"))
    return labels.join(stars, F.col("label") == F.col("u"), "left").select("label", F.coalesce("v", "label").alias("component"))


def component_sizes(edges: DataFrame) -> DataFrame:
    """component (its least label), size."""
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u is not null")
    if e.schema["u"].dataType.typeName() != "long":
        return weak_components(edges).groupBy("component").agg(F.count("*").alias("size"))
    at, tops = _hung_components(e)
    n = at.groupBy("v").agg(F.count("*").alias("n"))
    return n.join(tops, "v", "left").groupBy(F.coalesce("c", "v").alias("component")).agg(F.sum("n").alias("size"))


def _hung_components(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """forest.hung() nodes u, v, and v, c: the least label of v's component, where it is not v."""
    at, links = forest.hung(e)
    return at, _stars(staged(links)).select(F.col("u").alias("v"), F.col("v").alias("c"))


def _stars(e: DataFrame) -> DataFrame:
    """u, v: each node of the edges u > v that is not the least of its component, and the least.

    Alternating stars: every node's greater neighbours are hung on the least thing it sees, then every node hangs itself and
    its lesser neighbours on the least of them, until nothing changes.
    """
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large)
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(m.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e
        before = now


def trim(edges: DataFrame, peels: int = 3, rounds: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Edges left after taking out, again and again (or `rounds` times), nodes without edges in or without edges out. Several layers go between two writes.
    ends (degrees() of the edges), if given: the first layer goes before anything is written or shuffled by it."""
    e = edges.select("src", "dst").where("src <> dst")
    if ends is not None:
        inner = staged(ends.where("n_in > 0 and n_out > 0").select("label"))
        for c in ("src", "dst"):
            e = e.join(inner.withColumnRenamed("label", c), c, "left_semi")
    e = staged(e.select("src", "dst").distinct())
    n, left = e.count(), rounds
    while n and left != 0:
        left = None if left is None else left - 1
        kept = e
        for _ in range(peels):
            kept = kept.join(kept.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            kept = kept.select("src", "dst").join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        kept = staged(kept)
        m = kept.count()
        if m == n:
            return kept
        e, n = kept, m
    return e


def is_acyclic(edges: DataFrame) -> bool:
    """A11. A loop from a node to itself is a cycle; what is left after some trimming is followed.

    Every node chooses one edge (first to its least neighbour); doubling steps lead each along the choices to an end, which gives
    its length, or never to one: a cycle. Nodes with an edge to a greater length choose that instead; where there is
    none, lengths fall along all edges and there is no cycle. Lengths only grow, so it ends; long chains take
    as many steps as their length has binary digits.
    """
    if edges.where("src = dst").limit(1).count():
        return False
    e = trim(edges, rounds=1)
    choice = staged(e.groupBy("src").agg(F.min("dst").alias("dst")))
    while True:
        at, most = choice.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(1).cast("long").alias("n")), choice.count()
        jumps = 0
        while True:
            far = at.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("n").alias("more"))
            at = staged(at.join(far, "to", "left").select("node", F.coalesce("next", "to").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.col("next").isNotNull().alias("on")))
            jumps += 1
            if not at.where("on").limit(1).count():
                break
            if 2 ** (jumps - 1) >= most:
                return False
        length = at.select("node", "n")
        ahead = e.join(length.select(F.col("node").alias("dst"), F.col("n").alias("d")), "dst", "left").select("src", "dst", F.coalesce("d", F.lit(0)).alias("d"))
        best = ahead.groupBy("src").agg(F.max("d").alias("d"), F.min_by("dst", F.struct(-F.col("d"), F.col("dst"))).alias("better"))
        better = staged(best.join(length.withColumnRenamed("node", "src"), "src").where("d + 1 > n").select("src", "better"))
        if not better.limit(1).count():
            return True
        choice = staged(choice.join(better, "src", "left").select("src", F.coalesce("better", "dst").alias("dst")))


def strong_components(edges: DataFrame) -> DataFrame:
    """A10. label, component (its least label) for nodes in components of two or more; all other nodes are their own."""
    found = strong_cores(trim(edges))
    labels = edges.select(F.explode(F.array("src", "dst")).alias("label")).distinct()
    if found is None:
        return labels.select("label", F.col("label").alias("component"))
    return labels.join(found, "label", "left").select("label", F.coalesce("component", "label").alias("component"))


def strong_cores(e: DataFrame) -> DataFrame | None:
    """label, component (its least label) of the nodes in strong components of two or more; None where there is none. e: what trim() left.

    Colouring: in what is left of the graph the least label that reaches each node is its colour; the nodes that reach
    back to their colour's node within the colour are one component and are taken out.
    """
    found = None
    while e.limit(1).count():
        colour = staged(endpoints(e.withColumn("time", F.lit(0))).select("label").distinct().select("label", F.col("label").alias("colour")))
        while True:
            told = e.join(colour, e["src"] == colour["label"]).groupBy("dst").agg(F.min("colour").alias("c"))
            new = staged(colour.join(told, colour["label"] == told["dst"], "left").select("label", F.col("colour").alias("old"), F.least("colour", "c").alias("colour")))
            colour = new.select("label", "colour")
            if not new.where("old <> colour").limit(1).count():
                break
        a, b = colour.select(F.col("label").alias("src"), F.col("colour").alias("ca")), colour.select(F.col("label").alias("dst"), F.col("colour").alias("cb"))
        inner = staged(e.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", "ca"))
        back = front = staged(colour.where("label = colour"))
        while True:
            front = staged(inner.join(front, inner["dst"] == front["label"]).select(F.col("src").alias("label"), F.col("ca").alias("colour")).distinct().join(back, ["label", "colour"], "left_anti"))
            if not front.limit(1).count():
                break
            back = back.unionByName(front)
        got = staged(back.select("label", F.col("colour").alias("component")))
        found = got if found is None else found.unionByName(got)
        rest = e.join(got.select(F.col("label").alias("src")), "src", "left_anti").join(got.select(F.col("label").alias("dst")), "dst", "left_anti").select("src", "dst")
        e = trim(rest)
    return found


def component_buckets(components: DataFrame) -> DataFrame:
    """A19. Shares of nodes in the largest component and by size; the largest counts again in its size's bucket."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    total = F.sum("size")
    share = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)) / total, 6)
    s = F.col("size")
    return sizes.agg(F.round(F.max("size") / total, 6).alias("giant"), share(s > 20).alias("over_20"), share((s >= 6) & (s <= 20)).alias("from_6"), share((s >= 2) & (s <= 5)).alias("from_2"), share(s == 1).alias("isolated"))


def inventory(components: DataFrame, edges: DataFrame, types: DataFrame, least: int, n: int) -> DataFrame:
    """A20. Components but for the largest, of `least` nodes or more, the n largest: size, dominant type, node of most edges, earliest time."""
    d = degrees(edges)
    x = components.join(types, "label", "left").join(d, "label", "left")
    kinds = x.groupBy("component", "type").agg(F.count("*").alias("k"))
    kinds = kinds.groupBy("component").agg(F.max_by("type", F.struct("k", "type")).alias("dominant"))
    rows = x.groupBy("component").agg(F.count("*").alias("size"), F.max_by("label", F.struct("degree", "label")).alias("representative"))
    first = edges.join(components, edges["src"] == components["label"]).groupBy("component").agg(F.min("time").alias("earliest"))
    largest = rows.orderBy(F.desc("size"), "component").limit(1).select("component")
    rest = rows.join(largest, "component", "left_anti").where(F.col("size") >= least)
    return rest.join(kinds, "component").join(first, "component").orderBy(F.desc("size"), "component").limit(n)


def forest_times(edges: DataFrame) -> DataFrame:
    """A09, the series. Components after each time: nodes seen so far less the edges of a minimum spanning forest so far.

    Boruvka rounds: every component takes its earliest edge out (ties by the edge itself); the components that edges join
    become one by following each one's choice to its end, in doubling steps; edges between the same two keep the earliest.
    """
    key = F.struct("time", "a", "b").alias("k")
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "time").groupBy("a", "b").agg(F.min("time").alias("time"))
    e = staged(e.select(F.col("a").alias("x"), F.col("b").alias("y"), key))
    tree = None
    while e.limit(1).count():
        ends = e.select(F.inline(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("to"), "k"), F.struct(F.col("y").alias("c"), F.col("x").alias("to"), "k"))))
        best = staged(ends.groupBy("c").agg(F.min(F.struct("k", "to")).alias("m")).select("c", "m.k", "m.to"))
        tree = best.select("k").distinct() if tree is None else tree.unionByName(best.select("k").distinct())
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = staged(best.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")))
        while True:
            jump = staged(up.join(up.select(F.col("c").alias("to"), F.col("to").alias("next")), "to").select("c", F.col("to").alias("was"), F.col("next").alias("to")))
            up = jump.select("c", "to")
            if not jump.where("was <> to").limit(1).count():
                break
        ux, uy = (up.select(F.col("c").alias(c), F.col("to").alias(f"n{c}")) for c in "xy")
        merged = e.join(ux, "x").join(uy, "y").where("nx <> ny")
        e = staged(merged.groupBy(F.least("nx", "ny").alias("x"), F.greatest("nx", "ny").alias("y")).agg(F.min("k").alias("k")))
    seen = first_seen(edges).groupBy(F.col("first_time").alias("time")).agg(F.count("*").alias("d"))
    if tree is not None:
        seen = seen.unionByName(tree.groupBy(F.col("k.time").alias("time")).agg((-F.count("*")).alias("d")))
    return running_sums(staged(seen.groupBy("time").agg(F.sum("d").alias("d"))), [], "time", {"components": F.col("d")}).select("time", "components")
