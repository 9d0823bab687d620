"""Closures over parent-child relations (survey sections 2.4, 2.5). Loops run on frontiers of the whole table at once."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, a new local folder, but only if the executors are threads of the driver."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again: lineage ends there, and a lost executor loses nothing. It is deleted
    when the driver ends, since a result may read it until then."""
    path = f"{shared_dir(df.sparkSession)}/weft/loop-{uuid.uuid4().hex}"
    _left[path] = df.sparkSession
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: list[str], parts: int) -> DataFrame:
    """staged(), with all rows of a value of `by` in one of `parts` files that Spark knows of: steps that group by these columns do not shuffle."""
    spark, name = df.sparkSession, f"weft_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/weft/{name}"
    _left[path] = spark
    _named.append(name)
    df.repartition(parts, *by).write.bucketBy(parts, *by).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


#: Paths of loop tables, with their sessions, and the names of those that have one.
_left: dict[str, SparkSession] = {}
_named: list[str] = []


@atexit.register
def _sweep() -> None:
    for path, spark in _left.items():
        sc = spark.sparkContext
        if sc._jsc is None or sc._jsc.sc().isStopped():  # the session has ended before; its owner empties the folder
            continue
        if (name := path.rsplit("/", 1)[-1]) in _named:
            spark.sql(f"drop table if exists {name}")
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def direct(members: DataFrame) -> DataFrame:
    """M05."""
    return members.select("parent", "child")


def one_level(ids: DataFrame, members: DataFrame) -> DataFrame:
    """M01. A group's members, or the thing itself."""
    return ids.join(members, ids["id"] == members["parent"], "left").select("id", F.coalesce("child", "id").alias("member"))


def catalysts(reactions: DataFrame, catalysis: DataFrame) -> DataFrame:
    """M06. A reaction without a catalyst keeps one row with null."""
    return reactions.join(catalysis, "reaction", "left").select("reaction", "catalyst")


def walks(members: DataFrame) -> DataFrame:
    """root, node, path of every walk down from a parent, no node twice in a walk. Copies are kept. Walks are as many as there
    are ways, so ask for them only where ways matter: leaf_counts, depths and reachable carry totals instead."""
    m = staged(members.select("parent", "child"))
    front = m.where("parent <> child").select(F.col("parent").alias("root"), F.col("child").alias("node"), F.array("parent", "child").alias("path"))
    out = None
    while True:
        front = staged(front)
        if not front.limit(1).count():
            break
        out = front if out is None else out.unionByName(front)
        front = front.join(m, front["node"] == m["parent"]).where(~F.array_contains("path", F.col("child"))).select("root", F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"))
    return out if out is not None else front


def leaves(members: DataFrame) -> DataFrame:
    """M02, M03, M08. root, leaf, path: the ends of all walks, copies kept."""
    w = walks(members)
    return w.join(members.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("root", F.col("node").alias("leaf"), "path")


def leaf_counts(members: DataFrame) -> DataFrame:
    """M02. root, leaf, n: in how many ways each leaf is reached; copies of a relation count each, no node twice in a way.

    Parents are released when all their children are done and add up their children's totals, so a shared child is
    summed once and not once for each way to it. What leads into a cycle is never released and is walked.
    """
    m = staged(members.where("parent <> child").groupBy("parent", "child").agg(F.count("*").alias("k")))
    parents = m.select(F.col("parent").alias("node")).distinct()
    done = front = staged(m.select(F.col("child").alias("node")).distinct().join(parents, "node", "left_anti").select("node", F.col("node").alias("leaf"), F.lit(1).cast("long").alias("n")))
    state = staged(m.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("left")))
    while True:
        told = m.join(front.select(F.col("node").alias("child")).distinct(), "child").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("seen"))
        state = staged(state.join(told, "node", "left").select("node", (F.col("left") - F.coalesce("seen", F.lit(0))).alias("left")))
        ready = state.where("left = 0").select(F.col("node").alias("parent"))
        front = staged(m.join(ready, "parent").join(done, m["child"] == done["node"]).groupBy("parent", "leaf").agg(F.sum(F.col("k") * F.col("n")).alias("n")).select(F.col("parent").alias("node"), "leaf", "n"))
        state = staged(state.where("left > 0"))
        if not front.limit(1).count():
            break
        done = done.unionByName(front)
    out = done.where("node <> leaf").select(F.col("node").alias("root"), "leaf", "n")
    if state.limit(1).count():
        rest = reachable(members, state.select(F.col("node").alias("root"))).select(F.col("node").alias("parent")).distinct()
        ways = leaves(members.join(rest, "parent", "left_semi")).join(state.select(F.col("node").alias("root")), "root", "left_semi")
        out = out.unionByName(ways.groupBy("root", "leaf").agg(F.count("*").alias("n")))
    return out


def reachable(members: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """M07, M13. root, node: distinct, with the root itself. roots: where to begin, else every parent."""
    roots = members.select(F.col("parent").alias("root")).distinct() if roots is None else roots.select("root").distinct()
    m = staged(members.select("parent", "child"))
    all_ = front = staged(roots.select("root", F.col("root").alias("node")))
    while True:
        step = front.join(m, front["node"] == m["parent"]).select("root", F.col("child").alias("node")).distinct()
        front = staged(step.join(all_, ["root", "node"], "left_anti"))
        if not front.limit(1).count():
            break
        all_ = all_.unionByName(front)
    return all_


def ordered_distinct(x: DataFrame, root: str, member: str, pos: str, name: str) -> DataFrame:
    """M04. Distinct members of each root in the order of their first position."""
    first = x.groupBy(root, member).agg(F.min(pos).alias(pos))
    sorted_ = F.sort_array(F.collect_list(F.struct(pos, member)))
    return first.groupBy(root).agg(F.transform(sorted_, lambda s: s[member]).alias(name))


def depths(tree: DataFrame) -> DataFrame:
    """O01. node, depth: the longest chain of parents above, no node twice in a chain.

    A node is released when all its parents are done, and takes the greatest depth plus one; what lies behind a cycle is walked.
    """
    m = staged(tree.select("parent", "child").where("parent <> child").distinct())
    nodes = tree.select(F.col("parent").alias("node")).union(tree.select("child")).distinct()
    into = m.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("left"))
    state = nodes.join(into, "node", "left").select("node", F.coalesce("left", F.lit(0)).alias("left"))
    state = staged(state.select("node", "left", F.when(F.col("left") == 0, 0).alias("depth"), (F.col("left") == 0).alias("go")))
    while state.where("go").limit(1).count():
        told = state.where("go").join(m, F.col("node") == m["parent"]).groupBy(F.col("child").alias("node")).agg(F.count("*").alias("seen"), (F.max("depth") + 1).alias("d"))
        left = F.col("left") - F.coalesce("seen", F.lit(0))
        state = staged(state.join(told, "node", "left").select("node", left.alias("left"), F.greatest("depth", "d").alias("depth"), (F.col("seen").isNotNull() & (left == 0)).alias("go")))
    done = state.where("left = 0").select("node", "depth")
    late = state.where("left > 0").select("node")
    if not late.limit(1).count():
        return done
    ways = walks(tree).join(late, "node", "left_semi").groupBy("node").agg(F.max(F.size("path") - 1).alias("depth"))
    return done.unionByName(ways)


def deepest_parent(members: DataFrame, depth: DataFrame) -> DataFrame:
    """O02. reaction, pathway: the deepest of its pathways, the first in document order among equals."""
    x = members.join(depth, members["pathway"] == depth["node"])
    return x.groupBy("reaction").agg(F.max_by("pathway", F.struct(F.col("depth"), -F.col("doc_order"))).alias("pathway"))


def step_depths(spark: SparkSession, steps: DataFrame, links: DataFrame) -> DataFrame:
    """O03. pathway, step, local_order: longest way from a root inside each pathway, all pathways at once.

    Steps are released when all links into them were seen. Steps of a cycle never are: those that a root reaches keep the
    depth they have, the others get one more than the deepest (1 where there is none).
    """
    e = staged(links.select("pathway", "step", "next").join(steps.select("pathway", F.col("step").alias("next")), ["pathway", "next"]))
    into = e.groupBy("pathway", F.col("next").alias("step")).agg(F.count("*").alias("left"))
    state = steps.join(into, ["pathway", "step"], "left").select("pathway", "step", F.coalesce("left", F.lit(0)).alias("left"), F.lit(None).cast("int").alias("depth"))
    state = staged(state.withColumn("depth", F.when(F.col("left") == 0, 0)).withColumn("go", F.col("left") == 0))
    while state.where("go").limit(1).count():
        told = state.where("go").join(e, ["pathway", "step"]).groupBy("pathway", F.col("next").alias("step")).agg(F.count("*").alias("seen"), (F.max("depth") + 1).alias("d"))
        x = state.join(told, ["pathway", "step"], "left")
        left = F.col("left") - F.coalesce("seen", F.lit(0))
        state = staged(x.select("pathway", "step", left.alias("left"), F.greatest("depth", "d").alias("depth"), (F.col("seen").isNotNull() & (left == 0)).alias("go")))
    deepest = state.groupBy("pathway").agg(F.max("depth").alias("_max"))
    return state.join(deepest, "pathway").select("pathway", "step", F.coalesce("depth", F.col("_max") + 1, F.lit(1)).alias("local_order"))
