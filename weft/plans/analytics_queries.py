"""Statistics, series and components on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import analytics, report
from weft.plans import adapter
from weft.plans.graph_queries import coded_graph, graph
from weft.plans.registry import query, table

A = "with " + adapter.SQL
_ENDS = ", ends as (select src as label, time, 1 o from edges union all select dst, time, 0 from edges)"
_SEEN = _ENDS + ", seen as (select label, min(time) as first_time from ends group by label)"
_DEG = _ENDS + ", deg as (select label, sum(o)::bigint n_out, sum(1 - o)::bigint n_in, count(*)::bigint degree from ends group by label)"


@query("a01_summary", A + _DEG + "select nodes, degree_avg, degree_max, in_avg, hub, edges, ranks, round(edges / (nodes * (nodes - 1)), 9) density from (select count(*)::bigint nodes, round(avg(degree), 6) degree_avg, max(degree) degree_max, round(avg(n_in), 6) in_avg, arg_max(label, (degree, label)) hub from deg), (select count(*)::bigint edges, count(distinct time)::bigint ranks from edges)")
def a01(spark, d):
    return analytics.summary(graph(spark, d))


@query("a02_pathway_table", A + ", x as (select pathway, src as label, time from edges union all select pathway, dst, time from edges), e as (select pathway, count(*)::bigint n_edges, max(time) last_time, max(local_order) + 1 chain, round(avg((type = 'reaction')::int), 6) reaction_share from edges group by pathway) select pathway, n_edges, last_time, chain, reaction_share, n_nodes from e join (select pathway, count(distinct label)::bigint n_nodes from x group by pathway) using (pathway)")
def a02(spark, d):
    return analytics.pathway_table(graph(spark, d))


@query("a03_first_seen", A + _SEEN + "select label, first_time from seen")
def a03(spark, d):
    return analytics.first_seen(graph(spark, d))


@query("a04_recruitment_tail", A + _SEEN + "select round(avg((first_time > 0.8 * (select max(first_time) from seen))::int), 6) tail from seen")
def a04(spark, d):
    return analytics.recruitment_tail(coded_graph(spark, d))


@query("a05_edge_growth", A + "select type, time, (sum(count(*)) over (partition by type order by time))::bigint total from edges group by type, time")
def a05(spark, d):
    return analytics.growth(coded_graph(spark, d))


@query("a06_recruitment", A + _SEEN + "select first_time as time, count(*)::bigint as new, (sum(count(*)) over (order by first_time))::bigint total from seen group by first_time")
def a06(spark, d):
    return analytics.recruitment(coded_graph(spark, d))


@query("a07_growth_bands", A + ", g as (select pathway, step from (select distinct pathway from edges), (select unnest(range(max(local_order) + 1)) step from edges)), n as (select pathway, local_order step, count(*) n from edges group by all), t as (select pathway, step, sum(coalesce(n, 0)) over (partition by pathway order by step) total from g left join n using (pathway, step)) select step::int step, round(quantile_cont(total, 0.25), 4) low, round(quantile_cont(total, 0.5), 4) median, round(quantile_cont(total, 0.75), 4) high from t group by step")
def a07(spark, d):
    return analytics.growth_bands(graph(spark, d))


@query("a08_chain_lengths", A + "select pathway, max(local_order) + 1 as length from edges group by pathway")
def a08(spark, d):
    return analytics.chain_lengths(graph(spark, d))


_TYPE = "case left(label, 1) when 's' then 'protein' when 'p' then 'complex' when 'c' then 'small_molecule' end"


@query("a01_profile", "with recursive " + adapter.SQL + _DEG + f""", b as (select distinct src a, dst b from edges union select dst, src from edges), w using key (a) as (select a, min(least(a, b)) c from b group by a union select b.a, min(w.c) c from w join b on b.b = w.a join recurring.w as m on m.a = b.a where w.c < m.c group by b.a),
  r as (select distinct src a, dst b from edges union select r.a, e.dst from r join edges e on r.b = e.src), mutual as (select x.a, min(x.b) m from r x join r y on x.a = y.b and x.b = y.a group by x.a),
  ch as (select pathway, max(local_order) + 1 as n from edges where pathway is not null and local_order is not null group by pathway)
  select 'node_type' item, {_TYPE} as key, count(*)::double as value from deg group by all union all select 'edge_type', type, count(*) from edges group by type
  union all (select 'hub', label, degree from deg order by degree desc, label limit 10) union all select 'orphan_edges', '', count(*) filter (where pathway is null or local_order is null) from edges
  union all select 'chain', 'pathways', count(*) from ch union all select 'chain', 'min', min(n) from ch union all select 'chain', 'median', quantile_cont(n, 0.5) from ch union all select 'chain', 'max', max(n) from ch
  union all select 'components', 'weak', count(distinct c) from w union all select 'components', 'strong', count(distinct least(label, coalesce(m, label))) from deg left join mutual on a = label
  union all select 'dag', '', (select count(*) = 0 from r where a = b)::int""")
def a01_profile(spark, d):
    """In numbers: labels are named where hubs are shown."""
    g = adapter.known(coded_graph(spark, d, "dst"))
    return report.profile(g, adapter.kind(F.col("label")), name=adapter.label("label"))


@query("a02_full_table", "with recursive " + adapter.SQL + f""", g as (select distinct pathway, src, dst, type, time from edges), n as (select pathway, label, count(*) degree, min(time) seen from (select pathway, src as label, time from g union all select pathway, dst, time from g) group by all),
  b as (select pathway || src a, pathway || dst b from g union select pathway || dst, pathway || src from g), w using key (a) as (select a, min(least(a, b)) c from b group by a union select b.a, min(w.c) c from w join b on b.b = w.a join recurring.w as m on m.a = b.a where w.c < m.c group by b.a),
  r as (select pathway, src a, dst b from g union select r.pathway, r.a, g.dst from r join g on r.pathway = g.pathway and r.b = g.src), cyc as (select distinct pathway from r where a = b),
  s as (select pathway, c, count(*) s from n join w on a = pathway || label group by all), k as (select pathway, count(*) wccs, max(s) largest, count(*) filter (where s = 1) isolated from s group by pathway),
  l as (select pathway, max(seen) l from n group by pathway), f as (select pathway, count(*)::bigint nodes, round(avg(degree), 6) degree_avg, max(degree)::bigint degree_max, round(100 * avg((seen > 0.8 * case when l = 0 then 1 else l end)::int), 6) tail_pct,
    round(100 * avg(({_TYPE} = 'protein')::int), 6) pct_protein, round(100 * avg(({_TYPE} = 'complex')::int), 6) pct_complex, round(100 * avg(({_TYPE} = 'small_molecule')::int), 6) pct_small_molecule from n join l using (pathway) group by pathway),
  h as (select pathway, count(*)::bigint edges, count(distinct time)::bigint ranks, round(100 * avg((type = 'reaction')::int), 6) pct_reaction from g group by pathway)
  select pathway, nodes, edges, case when nodes > 1 then round(edges / (nodes * (nodes - 1)), 9) else 0 end density, degree_avg, degree_max, pathway not in (from cyc) is_dag, wccs::bigint wccs, round(100 * largest / nodes, 6) largest_wcc_pct, isolated::bigint isolated, ranks, tail_pct, pct_protein, pct_complex, pct_small_molecule, pct_reaction
  from f join h using (pathway) join k using (pathway)""")
def a02_full(spark, d):
    """In numbers: a node of a graph is its label's code times one over the graphs, plus the graph's number."""
    graphs = adapter.graphs(spark, d)
    w = F.lit(graphs.count() + 1).cast("long")
    g = adapter.known(coded_graph(spark, d, "dst"))
    e = g.join(graphs.select("_pathway", "graph"), F.col("pathway").eqNullSafe(F.col("_pathway")))
    own = lambda c: F.pmod(F.col(c), w)
    code = F.call_function("div", F.col("node") - own("node"), w)
    e = e.select(*[(F.col(c) * w + F.col("graph")).alias(c) for c in ("src", "dst")], "type", "time")
    x = report.table_of_marked(e, own, lambda nodes: nodes.withColumn("type", adapter.kind(code)))
    names = graphs.select(F.col("graph").alias("pathway"), "name").distinct()
    return x.join(names, "pathway").select(F.col("name").alias("pathway"), *x.columns[1:])


@query("a08_chain_histogram", A + """, ch as (select pathway, max(local_order) + 1 as n from edges group by pathway), t as (select max(n) top, quantile_cont(n, 0.5) median from ch),
  x as (select unnest(range(24)) bin, top, median from t), y as (select bin, pow(10, bin * (log10(top + 1.0) / 24)) low, pow(10, (bin + 1) * (log10(top + 1.0) / 24)) high, median from x)
  select bin::int bin, round(low, 6) low, round(high, 6) high, (select count(*) from ch where n >= low and (n < high or bin = 23))::bigint pathways, median from y""")
def a08_histogram(spark, d):
    return report.chain_histogram(graph(spark, d))


@query("a12_degree_distribution", A + _DEG + ", n as (select degree, count(*)::bigint nodes from deg group by degree) select degree, nodes, round(sum(nodes) over (order by degree desc) / (select sum(nodes) from n), 6) ccdf from n")
def a12(spark, d):
    return analytics.degree_distribution(coded_graph(spark, d))


@query("a13_clipped_degrees", A + _DEG + ", l as (select substr(label, 1, 1) as type, quantile_cont(n_in, 0.99) i, quantile_cont(n_out, 0.99) o from deg group by 1) select l.type, round(max(i), 4) in_limit, round(max(o), 4) out_limit, count(*) filter (where n_in > i or n_out > o)::bigint clipped from deg join l on substr(label, 1, 1) = l.type group by l.type")
def a13(spark, d):
    return analytics.clipped(graph(spark, d), F.substring("label", 1, 1))


@query("a14_type_breakdown", A + "select type, count(*)::bigint n, round(count(*) / (select count(*) from edges), 6) share from edges group by type")
def a14(spark, d):
    return analytics.breakdown(graph(spark, d), "type")


@query("a15_top_locations", "select coalesce(source, 'unknown') source, count(*)::bigint n from documents group by 1 order by n desc, source limit 10")
def a15(spark, d):
    return analytics.top(table(spark, d, "documents"), "source", 10)


@query("a16_catalyst_reuse", A + "select src, count(*)::bigint n from edges where type = 'catalysis' group by src order by n desc, src limit 15")
def a16(spark, d):
    return analytics.top(graph(spark, d).where("type = 'catalysis'"), "src", 15)


@query("a17_reaction_sizes", A + ", x as (select pathway, local_order, src as label from edges where type = 'reaction' union all select pathway, local_order, dst from edges where type = 'reaction'), s as (select pathway, local_order, count(distinct label)::bigint size from x group by all) select size, count(*)::bigint reactions from s group by size")
def a17(spark, d):
    return analytics.reaction_sizes(graph(spark, d))


@query("a18_edges_per_pathway", A + "select pathway, count(*)::bigint n from edges group by pathway order by n desc, pathway limit 20")
def a18(spark, d):
    return analytics.top(graph(spark, d), "pathway", 20)


#: Labels of sparse() from here on are pairs of orders.
PAIRS = 1_000_000_000_000


def sparse(spark, d):
    """Every order, from a part of its customer's to its pair of orders: nodes of so few edges that many components are left."""
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") * 24 + F.col("o_orderkey") % 24).alias("src"), (PAIRS + F.floor(F.col("o_orderkey") / 2)).alias("dst"), (F.col("o_orderkey") % 100).alias("time"))


_SPARSE = f"e as (select o_custkey * 24 + o_orderkey % 24 src, {PAIRS} + o_orderkey // 2 dst, o_orderkey % 100 as time from orders)"
_WCC = f"with recursive {_SPARSE}, b as (select distinct src a, dst b from e union select dst, src from e), w using key (a) as (select a, min(least(a, b)) c from b group by a union select b.a, min(w.c) c from w join b on b.b = w.a join recurring.w as m on m.a = b.a where w.c < m.c group by b.a)"


@query("a09_weak_components", _WCC + " select a as label, c as component from w")
def a09(spark, d):
    return analytics.weak_components(sparse(spark, d))


@query("a09_components_over_time")
def a09t(spark, d):
    e = sparse(spark, d)
    return analytics.forest_times(e)


@query("a10_strong_components")
def a10(spark, d):
    o = table(spark, d, "orders")
    e = o.select((F.col("o_custkey") % 400).alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 400).alias("dst")).where("src < 300 or dst > src").distinct()
    return analytics.strong_components(e)


@query("a11_acyclic", """with recursive p as (select distinct l_suppkey src, l_suppkey + l_linenumber dst from lineitem), q as (select * from p union select max(dst), min(src) from p),
  r as (select src a, dst b from p union select r.a, p.dst from r join p on r.b = p.src), t as (select src a, dst b from q union select t.a, q.dst from t join q on t.b = q.src)
  select not exists (select 1 from r where a = b) forward, not exists (select 1 from t where a = b) with_return""")
def a11(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("dst")).distinct()
    back = p.unionByName(p.groupBy().agg(F.max("dst").alias("src"), F.min("src").alias("dst")))
    return spark.createDataFrame([(analytics.is_acyclic(p), analytics.is_acyclic(back))], "forward boolean, with_return boolean")


@query("a19_component_buckets", _WCC + ", s as (select c, count(*) size from w group by c) select round(max(size) / sum(size), 6) giant, round(coalesce(sum(size) filter (where size > 20), 0) / sum(size), 6) over_20, round(coalesce(sum(size) filter (where size between 6 and 20), 0) / sum(size), 6) from_6, round(coalesce(sum(size) filter (where size between 2 and 5), 0) / sum(size), 6) from_2, round(coalesce(sum(size) filter (where size = 1), 0) / sum(size), 6) isolated from s")
def a19(spark, d):
    return analytics.component_buckets(analytics.weak_components(sparse(spark, d)))


@query("a20_inventory", _WCC + f""", deg as (select label, count(*) degree from (select src as label from e union all select dst from e) group by label), s as (select c, count(*)::bigint size, arg_max(a, (degree, a)) representative, case when count(*) filter (where a >= {PAIRS}) > count(*) filter (where a < {PAIRS}) then 'dst' else 'src' end dominant from w join deg on a = label group by c),
  f as (select c, min(time) earliest from e join w on src = a group by c), big as (select c from s order by size desc, c limit 1)
  select c as component, size, representative, dominant, earliest from s join f using (c) where c not in (select c from big) and size >= 2 order by size desc, c limit 20""")
def a20(spark, d):
    e = sparse(spark, d)
    c = analytics.weak_components(e)
    types = c.select("label", F.when(F.col("label") >= PAIRS, "dst").otherwise("src").alias("type"))
    return analytics.inventory(c, e, types, 2, 20)
