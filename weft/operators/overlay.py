"""Overlay of disease reactions on a healthy graph (survey section 2.8). The graph is not changed; new edges are returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from weft.operators import closure
from weft.operators.rank import global_rank


def name_index(nodes: DataFrame) -> DataFrame:
    """D01. key, label: lower-cased name (or label) and aliases; several labels may share a key."""
    own = nodes.select(F.lower(F.trim(F.coalesce("name", "label"))).alias("key"), "label")
    other = nodes.select(F.explode("aliases").alias("key"), "label").select(F.lower(F.trim("key")).alias("key"), "label")
    return own.union(other).where("key <> ''").distinct()


#: Characters in a gram.
GRAM = 3


def containing(short: DataFrame, long: DataFrame) -> DataFrame:
    """short, long: distinct pairs of strings of which the second holds the first. short and long: a column of that name; empty strings pair with nothing.

    An inverted index: a short string is looked up by the rarest of its grams (itself, where it is shorter than a gram) among
    the grams of the long ones, and candidates are compared. So a string meets those that share its rarest gram only.
    """
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(F.col(c), i, F.lit(n))))
    short, long = short.where("short <> ''").distinct(), long.where("long <> ''").distinct()
    size = F.least(F.length("short"), F.lit(GRAM))
    asked = short.select("short", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("short") - size + 1), lambda i: F.substring(F.col("short"), i, size)))).alias("gram"))
    held = long.select("long", F.explode(F.flatten(F.array(*(F.when(F.length("long") >= n, grams("long", n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1))))).alias("gram"))
    held = held.join(asked.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    rare = asked.join(often, "gram", "left").groupBy("short").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    rare = closure.staged(rare)
    return rare.join(held, "gram").where(F.col("long").contains(F.col("short"))).select("short", "long")


def similar_names(names: DataFrame, keys: DataFrame) -> DataFrame:
    """key, other: pairs of a name (key) and a known name (other) of which one holds the other."""
    a = containing(names.select(F.col("key").alias("short")), keys.select(F.col("other").alias("long"))).select(F.col("short").alias("key"), F.col("long").alias("other"))
    b = containing(keys.select(F.col("other").alias("short")), names.select(F.col("key").alias("long"))).select(F.col("long").alias("key"), F.col("short").alias("other"))
    return closure.staged(a.union(b).distinct())


def resolve(queries: DataFrame, ids: DataFrame, names: DataFrame) -> DataFrame:
    """D08. query, label, how: by database id, then by exact name, then by one name within the other.

    queries: query, db_id, name. Only distinct names that the equi-joins left go into the last (similar_names); of several
    keys the least wins.
    """
    a = queries.join(ids, "db_id").select("query", "label", F.lit("id").alias("how"))
    rest = queries.join(a, "query", "left_anti").withColumn("key", F.lower(F.trim("name")))
    b = rest.join(names.groupBy("key").agg(F.min("label").alias("label")), "key").select("query", "label", F.lit("name").alias("how"))
    rest = rest.join(b, "query", "left_anti").where("key <> ''")
    left, keys = rest.select("key").distinct(), names.groupBy("key").agg(F.min("label").alias("label")).select(F.col("key").alias("other"), "label")
    near = similar_names(left, keys).join(keys, "other").groupBy("key").agg(F.min_by("label", "other").alias("label"))
    c = rest.join(near, "key").select("query", "label", F.lit("part").alias("how"))
    return a.unionByName(b).unionByName(c)


def all_matches(queries: DataFrame, ids: DataFrame, names: DataFrame, fuzzy: bool = True) -> DataFrame:
    """D08 with every match. name, db_id, label: by database id, else all of that name, else (fuzzy) all whose name holds or is held. queries: name, db_id, distinct."""
    q = queries.withColumn("key", F.lower(F.trim("name")))
    a = q.join(ids, "db_id").select("name", "db_id", "label", "key")
    seen = lambda x, y: x.join(y.select(F.col("name").alias("_n"), F.col("db_id").alias("_d")).distinct(), F.col("name").eqNullSafe(F.col("_n")) & F.col("db_id").eqNullSafe(F.col("_d")), "left_anti")
    rest = seen(q, a)
    b = rest.join(names, "key").select("name", "db_id", "label", "key")
    out = a.unionByName(b)
    if fuzzy:
        rest = seen(rest, b)
        near = similar_names(rest.select("key").distinct(), names.select(F.col("key").alias("other")).distinct())
        c = rest.join(near, "key").join(names.withColumnRenamed("key", "other"), "other").select("name", "db_id", "label", "key")
        out = out.unionByName(c)
    return out.select("name", "db_id", "label").distinct()


def diseases(pathways: DataFrame, members: DataFrame) -> DataFrame:
    """D03, D04. reaction, disease: of the pathways that hold it the last that is not a root, else the first root.

    pathways: pathway, disease, doc_order, is_root; members: pathway, reaction.
    """
    x = members.join(pathways.where("disease is not null"), "pathway")
    last = F.expr("max_by(disease, doc_order) filter (where not is_root)")
    first = F.expr("min_by(disease, doc_order) filter (where is_root)")
    return x.groupBy("reaction").agg(F.coalesce(last, first).alias("disease"))


def ranked(reactions: DataFrame, base: int) -> DataFrame:
    """D10, D15. time = base + 1 + rank by step key; a reaction without an anchor uses its rank too."""
    if not isinstance(reactions.schema["step_key"].dataType, NumericType):
        w = Window.orderBy("step_key", "reaction")  # the reactions of one disease file
        return reactions.withColumn("time", F.lit(base) + F.row_number().over(w))
    by = F.coalesce(F.col("step_key").cast("double"), F.lit(float("-inf")))  # nulls come first
    x = global_rank(reactions, by, [F.col("step_key"), F.col("reaction")], "time")
    return x.withColumn("time", F.lit(base) + 1 + F.col("time"))


def loss_edges(reactions: DataFrame, branches: DataFrame, variants: DataFrame) -> DataFrame:
    """D13. For reactions without products: branch to variant at time, variant to disease right after."""
    x = reactions.where("n_products = 0")
    a = x.join(branches, "reaction").join(variants, "reaction").select(F.col("branch").alias("src"), F.col("variant").alias("dst"), F.lit("disease_branch").alias("type"), F.lit(None).cast("string").alias("subtype"), "time", "reaction")
    b = x.join(branches.select("reaction").distinct(), "reaction").join(variants, "reaction").select(F.col("variant").alias("src"), F.col("disease").alias("dst"), F.lit("loss_of_function").alias("type"), F.lit(None).cast("string").alias("subtype"), (F.col("time") + 1).alias("time"), "reaction")
    return a.unionByName(b)


def gain_edges(reactions: DataFrame, branches: DataFrame, variants: DataFrame, products: DataFrame) -> DataFrame:
    """D14. For reactions with products: branch to product, variant to branch, variant to disease, product to disease."""
    x = reactions.where("n_products > 0").join(branches.select("reaction").distinct(), "reaction")
    kind = lambda t, s: (F.lit(t).alias("type"), F.lit(s).cast("string").alias("subtype"))
    a = x.join(branches, "reaction").join(products, "reaction").select(F.col("branch").alias("src"), F.col("product").alias("dst"), *kind("reaction", "disease"), "time", "reaction")
    b = x.join(variants, "reaction").join(branches, "reaction").select(F.col("variant").alias("src"), F.col("branch").alias("dst"), *kind("catalysis", "disease_aberrant"), "time", "reaction")
    c = x.join(variants, "reaction").select(F.col("variant").alias("src"), F.col("disease").alias("dst"), *kind("aberrant_product", None), (F.col("time") + 1).alias("time"), "reaction")
    e = x.join(products, "reaction").select(F.col("product").alias("src"), F.col("disease").alias("dst"), *kind("disease_progression", None), (F.col("time") + 2).alias("time"), "reaction")
    return a.unionByName(b).unionByName(c).unionByName(e)


def unanchored(reactions: DataFrame, branches: DataFrame) -> DataFrame:
    """D10."""
    return reactions.join(branches, "reaction", "left_anti")


def by_first(x: DataFrame, key: str, order: str) -> DataFrame:
    """D11. The first writer of each key wins."""
    rest = [c for c in x.columns if c not in (key, order)]
    return x.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in rest])
