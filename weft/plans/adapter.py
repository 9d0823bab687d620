"""The driver's star schema read as a pathway graph: an order is a reaction in the order of its date; its suppliers are
reactants, its parts products, its customer the catalyst; a customer's nation is the pathway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.rank import global_rank
from weft.plans.registry import table

#: The same relations for DuckDB.
SQL = """
reaction as (select o_orderkey reaction, 'c' || o_custkey catalyst, case when o_orderstatus = 'F' then 'INHIBITION' else 'ACTIVATION' end control,
    n_name pathway, row_number() over (order by o_orderdate, o_orderkey) - 1 as time, (row_number() over (partition by n_name order by o_orderdate, o_orderkey) - 1)::bigint local_order
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
lefts as (select reaction, label, row_number() over (partition by reaction order by label) - 1 pos from (select distinct l_orderkey reaction, 's' || l_suppkey as label from lineitem)),
rights as (select reaction, label, row_number() over (partition by reaction order by label) - 1 pos from (select distinct l_orderkey reaction, 'p' || l_partkey as label from lineitem)),
log as (
  select catalyst src, l.label dst, 'catalysis' as type, time, local_order, pathway, control catalysis_type, time * 1000000 + l.pos * 1000 seq from reaction join lefts l using (reaction)
  union all
  select l.label, r.label, 'reaction', time, local_order, pathway, null, time * 1000000 + l.pos * 1000 + 1 + r.pos from reaction join lefts l using (reaction) join rights r using (reaction)),
edges as (select src, dst, arg_max(type, seq) as type, max(time) as time, arg_max(local_order, seq) local_order, arg_max(pathway, seq) pathway, arg_max(catalysis_type, seq) filter (where type = 'catalysis') catalysis_type from log group by src, dst)
"""


def reactions(spark, d: str) -> DataFrame:
    """reaction, catalyst, control, pathway, time (global rank), local_order (rank in its pathway)."""
    control = F.when(F.col("o_orderstatus") == "F", "INHIBITION").otherwise("ACTIVATION")
    return _ordered(spark, d, table(spark, d, "nation"), F.concat(F.lit("c"), "o_custkey"), control, "n_name")


def _ordered(spark, d: str, nation: DataFrame, catalyst: Column, control: Column, pathway: str) -> DataFrame:
    o, c = (table(spark, d, x) for x in ("orders", "customer"))
    r = o.join(c, o.o_custkey == c.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    r = r.select(F.col("o_orderkey").alias("reaction"), catalyst.alias("catalyst"), control.alias("control"), F.col(pathway).alias("pathway"), "o_orderdate")
    r = global_rank(r, F.unix_micros(F.col("o_orderdate").cast("timestamp")), [F.col("reaction")], "time")
    w = Window.partitionBy("pathway").orderBy("time")
    return r.withColumn("local_order", (F.row_number().over(w) - 1).cast("long")).drop("o_orderdate")


def side(spark, d: str, name: str) -> DataFrame:
    """reaction, label, pos of one side: left or right."""
    key, mark = ("l_suppkey", "s") if name == "left" else ("l_partkey", "p")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("reaction"), F.concat(F.lit(mark), key).alias("label")).distinct()
    return x.withColumn("pos", (F.row_number().over(Window.partitionBy("reaction").orderBy("label")) - 1).cast("long"))


def sides(spark, d: str, parts: int) -> DataFrame:
    """reaction, lefts, rights: the labels of both sides in their order, in so many parts."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("reaction"), "l_suppkey", "l_partkey").repartition(parts, "reaction")
    labels = lambda mark, key: F.transform(F.sort_array(F.collect_set(F.struct(F.concat(F.lit(mark), key).alias("l")))), lambda s: s["l"])
    return x.groupBy("reaction").agg(labels("s", "l_suppkey").alias("lefts"), labels("p", "l_partkey").alias("rights"))


def parts(spark, d: str) -> int:
    """So many parts that about a million writes fall to each."""
    return max(spark.sparkContext.defaultParallelism, table(spark, d, "lineitem").count() // 200_000)


#: What labels begin with; a label's code is four times its number plus the place of its mark here.
MARKS = "spc"
#: The code of a null label: sets keep no nulls.
NO_LABEL = -(2**63)


def _code(mark: str, key: str) -> Column:
    return F.coalesce(F.col(key).cast("long") * 4 + MARKS.index(mark), F.lit(NO_LABEL))


def known(edges: DataFrame) -> DataFrame:
    """Edges between codes of labels, without those that have a null end."""
    return edges.where((F.col("src") != NO_LABEL) & (F.col("dst") != NO_LABEL))


def kind(code: Column) -> Column:
    """Suppliers are proteins, parts complexes, customers small molecules."""
    return F.element_at(F.array(*map(F.lit, ("protein", "complex", "small_molecule"))), (code.bitwiseAND(3) + 1).cast("int"))


def label(code: str) -> Column:
    mark = F.substr(F.lit(MARKS), (F.col(code).bitwiseAND(3) + 1).cast("int"), F.lit(1))
    return F.when(F.col(code) != NO_LABEL, F.concat(mark, F.shiftright(code, 2).cast("string"))).alias(code)


def _pathways(spark, d: str) -> DataFrame:
    """nation with a number for each name, null for none (25 rows)."""
    return table(spark, d, "nation").withColumn("_pathway", F.when(F.col("n_name").isNotNull(), F.dense_rank().over(Window.orderBy("n_name"))))


def graphs(spark, d: str) -> DataFrame:
    """_pathway, graph, name: for each number of coded() pathways that of its graph, from 1, and the graph's name; no pathway has the empty one (25 rows)."""
    x = _pathways(spark, d).select("_pathway", F.coalesce("n_name", F.lit("")).alias("name")).distinct()
    return x.withColumn("graph", F.dense_rank().over(Window.orderBy("name")).cast("long"))


def coded(spark, d: str, parts: int) -> DataFrame:
    """reactions() with both sides(), all in numbers: labels by their codes, pathways by those of their names, control as whether it inhibits.
    So the fold aggregates values of fixed width, without sorts. Sides are in the order of codes; order within a side only counts for
    a catalyst that stands on the left, which no customer does."""
    r = _ordered(spark, d, _pathways(spark, d), _code("c", "o_custkey"), F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)), "_pathway")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("reaction"), "l_suppkey", "l_partkey").repartition(parts, "reaction")
    codes = lambda mark, key: F.sort_array(F.collect_set(_code(mark, key)))
    return r.join(x.groupBy("reaction").agg(codes("s", "l_suppkey").alias("lefts"), codes("p", "l_partkey").alias("rights")), "reaction")


def coded_lefts(spark, d: str, parts: int) -> DataFrame:
    """time, lefts of reactions(), in numbers: the codes of the left side, but for null labels."""
    x = table(spark, d, "lineitem").where("l_suppkey is not null").select(F.col("l_orderkey").alias("reaction"), _code("s", "l_suppkey").alias("l")).repartition(parts, "reaction")
    return reactions(spark, d).select("reaction", "time").join(x.groupBy("reaction").agg(F.collect_set("l").alias("lefts")), "reaction").select("time", "lefts")


def last_digit(code: str) -> Column:
    """Of a label's code the last digit of the label."""
    return F.abs(F.shiftright(code, 2)) % 10


def decoded(spark, d: str, edges: DataFrame) -> DataFrame:
    """Folded edges of coded() reactions with labels, names and words again."""
    names = _pathways(spark, d).groupBy("_pathway").agg(F.first("n_name").alias("_name"))
    control = F.when(F.col("catalysis_type"), "INHIBITION").when(~F.col("catalysis_type"), "ACTIVATION")
    x = edges.join(names, F.col("pathway") == F.col("_pathway"), "left")  # goes where no one asks for the name
    return x.select(label("src"), label("dst"), "type", "time", "local_order", F.col("_name").alias("pathway"), control.alias("catalysis_type"))
