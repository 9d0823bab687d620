"""Statistics of event histories (survey section 2.13, L08): what the events before one say about it.

Events are rows (event, src, dst, type, time). Those before an event are the ones of less time, and at the same time of a
lesser event id. Rows with a null end, type or time have no statistics and count for none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.closure import staged
from weft.operators.rank import global_rank, running_sums


def positions(events: DataFrame) -> DataFrame:
    """events with pos, their rank from 0."""
    whole = events.dropna(subset=["event", "src", "dst", "type", "time"])
    return staged(global_rank(whole.select("event", "src", "dst", "type", "time"), F.col("time"), [F.col("event")], "pos"))


def replayed(train: DataFrame, scored: DataFrame) -> DataFrame:
    """The events of both with pos, in which all of `train` come before `scored`, and with own: true for scored ones. So
    totals of training are where every scored event starts, and each is added after it has been scored."""
    t = positions(train).withColumn("own", F.lit(False))
    n = t.count()
    return t.unionByName(positions(scored).withColumn("own", F.lit(True)).withColumn("pos", F.col("pos") + n))


def _triples(e: DataFrame) -> DataFrame:
    """type, i, k, j, each once, for which events i to k, k to j and i to j all exist.

    Triangles are listed from their end of least degree: an end has at most sqrt(2 m) neighbours above it in that order (m
    pairs), so a hub's ways are not spelt out. Triples with two equal ends come from events of a node with itself.
    """
    p = staged(e.select("type", "src", "dst").distinct())
    loops = p.where("src = dst").select("type", F.col("src").alias("loop"))
    lines = p.where("src <> dst").select("type", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = lines.select("type", F.explode(F.array("a", "b")).alias("x")).groupBy("type", "x").agg(F.count("*").alias("d"))
    end = lambda c: degree.select("type", F.col("x").alias(c), F.struct("d", F.col("x")).alias(f"o{c}"))
    up = lines.join(end("a"), ["type", "a"]).join(end("b"), ["type", "b"])
    first = F.col("oa") < F.col("ob")
    up = staged(up.select("type", F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), F.greatest("oa", "ob").alias("o")))
    wedges = up.select("type", "u", "v", F.col("o").alias("ov")).join(up.select("type", "u", F.col("v").alias("w"), F.col("o").alias("ow")), ["type", "u"]).where("ov < ow")
    found = wedges.join(up.select("type", F.col("u").alias("v"), F.col("v").alias("w")), ["type", "v", "w"]).select("type", "u", "v", "w")
    turns = [F.struct(*[F.col(c).alias(n) for c, n in zip(x, "ikj")]) for x in ("uvw", "uwv", "vuw", "vwu", "wuv", "wvu")]
    all_ways = found.select("type", F.inline(F.array(*turns)))
    for x, y in ("ik", "kj", "ij"):
        all_ways = all_ways.join(p.select("type", F.col("src").alias(x), F.col("dst").alias(y)), ["type", x, y], "left_semi")
    flat = p.where("src <> dst")
    at_i = flat.join(loops, (flat["type"] == loops["type"]) & (F.col("src") == F.col("loop"))).select(flat["type"], F.col("src").alias("i"), F.col("src").alias("k"), F.col("dst").alias("j"))
    at_j = flat.join(loops, (flat["type"] == loops["type"]) & (F.col("dst") == F.col("loop"))).select(flat["type"], F.col("src").alias("i"), F.col("dst").alias("k"), F.col("dst").alias("j"))
    there = p.join(loops.select("type", F.col("loop").alias("src")), ["type", "src"]).select("type", F.col("src").alias("i"), F.col("dst").alias("k"))
    back = there.join(p.select("type", F.col("src").alias("k"), F.col("dst").alias("i")), ["type", "k", "i"], "left_semi").select("type", "i", "k", F.col("i").alias("j"))
    return all_ways.select("type", "i", "k", "j").unionByName(at_i).unionByName(at_j).unionByName(back)


def growth(e: DataFrame, t: DataFrame) -> DataFrame:
    """type, src, dst, pos, g: by how much the event at pos adds to the ways of two events from src to dst, one row for each
    middle node. t: the triples type, i, k, j to look at."""
    half = lambda x, y, a: t.join(e.select("type", F.col("src").alias(x), F.col("dst").alias(y), "pos"), ["type", x, y]).select("type", "i", "k", "j", "pos", F.lit(a).alias("a"), F.lit(1 - a).alias("b"))
    steps = half("i", "k", 1).unionByName(half("k", "j", 0)).groupBy("type", "i", "k", "j", "pos").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    steps = running_sums(staged(steps), ["type", "i", "k", "j"], "pos", {"na": F.col("a"), "nb": F.col("b")}, inclusive=False)
    g = F.col("a") * F.col("nb") + F.col("b") * F.col("na") + F.col("a") * F.col("b")
    return steps.select("type", F.col("i").alias("src"), F.col("j").alias("dst"), "pos", g.alias("g"))


#: Events of a block of transitivity(), of all types.
BLOCK = 400_000


def _ways(rows):
    """event, transitivity of one type's block: counts of pairs at its start (pos -1), then its events in their order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = rows.sort_by("pos")
    out, into, sums = {}, {}, []
    for x, y, pos, n in zip(*(rows.column(c).to_pylist() for c in ("src", "dst", "pos", "n"))):
        a, b = out.setdefault(x, {}), into.setdefault(y, {})
        if pos >= 0:
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            sums.append(sum(v * large[k] for k, v in small.items() if k in large))
        a[y] = b[x] = a.get(y, 0) + n
    return pa.table({"event": rows.column("event").filter(pc.greater_equal(rows.column("pos"), 0)), "transitivity": pa.array(sums, pa.int64())})


def transitivity(e: DataFrame, block: int = BLOCK) -> DataFrame:
    """event, transitivity: over all k, how many earlier events of the type lead from src to k, times how many from k to dst.
    e: events with pos (from positions() or replayed()).

    Positions are cut into blocks of `block`. A block gets its events and, at its start, the counts of the legs that its pairs
    ask for; within it the counts are kept up to date and each event's sum is made anew. So neither a hub's ways are spelt out nor
    a row made for each event and triangle: rows grow with the events, and with blocks times the triangles of their pairs.
    """
    t = staged(_triples(e))
    cut = F.floor(F.col("pos") / block).alias("block")
    asked = e.select("type", cut, F.col("src").alias("i"), F.col("dst").alias("j")).distinct().join(t, ["type", "i", "j"])
    legs = asked.select("type", "block", F.inline(F.array(F.struct(F.col("i").alias("src"), F.col("k").alias("dst")), F.struct(F.col("k").alias("src"), F.col("j").alias("dst"))))).distinct()
    zero = F.lit(0).cast("long")
    counts = e.groupBy("type", cut, "src", "dst").agg(F.count("*").alias("n")).select("type", "block", "src", "dst", "n", F.lit(False).alias("leg"))
    marks = counts.unionByName(legs.select("type", "block", "src", "dst", zero.alias("n"), F.lit(True).alias("leg"))).groupBy("type", "block", "src", "dst").agg(F.sum("n").alias("n"), F.max("leg").alias("leg"))
    before = Window.partitionBy("type", "src", "dst").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = marks.withColumn("n", F.sum("n").over(before)).where("leg and n > 0")
    none = F.lit(None).cast(e.schema["event"].dataType)
    rows = start.select("type", "block", "src", "dst", F.lit(-1).cast("long").alias("pos"), "n", none.alias("event"))
    rows = rows.unionByName(e.select("type", cut, "src", "dst", F.col("pos").cast("long").alias("pos"), F.lit(1).cast("long").alias("n"), "event"))
    return rows.groupBy("type", "block").applyInArrow(_ways, f"event {e.schema['event'].dataType.simpleString()}, transitivity long")


def likeness(events: DataFrame, nodes: DataFrame, scores: list[str], kind: str) -> DataFrame:
    """event, sim_<score> for each of scores: minus the distance of the ends' scores, and same: 1 where the ends' kinds agree,
    else 0. nodes: label, scores, kind. Null where an end or its value is unknown."""
    end = lambda s: nodes.select(F.col("label").alias(s), *[F.col(c).alias(f"_{s}_{c}") for c in [*scores, kind]])
    x = events.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    sim: list[Column] = [(-F.abs(F.col(f"_src_{c}") - F.col(f"_dst_{c}"))).alias(f"sim_{c}") for c in scores]
    return x.select("event", *sim, (F.col(f"_src_{kind}") == F.col(f"_dst_{kind}")).cast("int").alias("same"))
