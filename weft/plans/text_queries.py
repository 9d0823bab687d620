"""Scalar rules, reaction kinds, payloads and the overlay on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as t
from weft.operators import disease, overlay, reactions
from weft.plans.registry import query, table


@query("p01_normal_id", "with n as (select p_partkey, case p_partkey % 3 when 0 then p_name || ' [' || p_brand || ':' || p_partkey || ']' when 1 then p_brand || ':' || p_partkey || ' rest' else p_name end s from part) select p_partkey, case when regexp_matches(s, '\\[([^:]+):(\\S+)\\]') then regexp_extract(s, '\\[([^:]+):(\\S+)\\]', 1) || ':' || regexp_extract(s, '\\[([^:]+):(\\S+)\\]', 2) when regexp_matches(s, '^(.+?):(\\S+)') then regexp_extract(s, '^(.+?):(\\S+)', 1) || ':' || regexp_extract(s, '^(.+?):(\\S+)', 2) else s end id from n")
def p01(spark, d):
    k = F.col("p_partkey") % 3
    s = F.when(k == 0, F.concat("p_name", F.lit(" ["), "p_brand", F.lit(":"), "p_partkey", F.lit("]"))).when(k == 1, F.concat("p_brand", F.lit(":"), "p_partkey", F.lit(" rest"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", t.normal_id(s).alias("id"))


@query("p02_local_ref", "select page_id, trim('#' || url || '#', '#') ref from pages")
def p02(spark, d):
    return table(spark, d, "pages").select("page_id", t.local_ref(F.concat(F.lit("#"), "url", F.lit("#"))).alias("ref"))


@query("p03_p04_names", "select p_partkey, coalesce(case when p_partkey % 2 = 0 then p_name end, case when p_partkey % 3 = 0 then p_brand end, p_partkey::varchar) name, case when p_partkey % 4 = 0 then p_type end db from part")
def p03(spark, d):
    k = F.col("p_partkey")
    comments = F.when(k % 4 == 0, F.array(F.lit("other"), F.concat(F.lit("Database ID: "), "p_type"))).otherwise(F.array(F.lit("other")))
    return table(spark, d, "part").select("p_partkey", t.display_name(F.when(k % 2 == 0, F.col("p_name")), F.when(k % 3 == 0, F.array("p_brand")), k.cast("string")).alias("name"), t.first_with_prefix(comments, "Database ID:").alias("db"))


@query("p05_label", "select p_partkey, case when p_size % 2 = 0 then '[OR] ' else '' end || p_name || case when p_size % 3 = 0 then ' [' || p_brand || ']' else '' end as label from part")
def p05(spark, d):
    return table(spark, d, "part").select("p_partkey", t.label(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(""), F.when(F.col("p_size") % 2 == 0, F.array("p_type"))).alias("label"))


@query("p09_p10_variants", "select page_id, regexp_matches(html, '(?i)(?:^|[\\s_-])[A-Z]\\d+(?:\\*|[A-Z]|del|ins|dup|fs|Ter|TER|X\\b)') named, page_id % 2 = 0 and regexp_matches(lower(html), 'variant|mutant|defect|the') grouped from pages")
def p09(spark, d):
    h = F.col("html")
    x = table(spark, d, "pages")
    grouped = t.is_variant_group(h, F.when(F.col("page_id") % 2 == 0, F.array("url")), t.VARIANT_WORDS + "|the")
    return x.select("page_id", t.is_variant_name(h).alias("named"), grouped.alias("grouped"))


@query("p11_p12_p14_disease", "with x as (select item_id, 'see (Name ' || item_id || '; MIM:' || (item_id * 7) || ') and mim:12 MIM:' || (item_id * 7) || ' MIM:3 ' || substr(text, 1, 40) s, 'it causes SCID-' || item_id || ' often' u from benchmark) select item_id, list_distinct_ordered ids, 'Name ' || item_id as label, 'SCID-' || item_id cause, '[DISEASE] Name ' || item_id || ' (OMIM:' || ids[1] || ')' node from (select *, case when item_id * 7 = 3 then ['3'] else [(item_id * 7)::varchar, '3'] end ids, case when item_id * 7 = 3 then ['3'] else [(item_id * 7)::varchar, '3'] end list_distinct_ordered from x)".replace("list_distinct_ordered ids, 'Name '", "ids, 'Name '"))
def p11(spark, d):
    s = F.concat(F.lit("see (Name "), "item_id", F.lit("; MIM:"), F.col("item_id") * 7, F.lit(") and mim:12 MIM:"), F.col("item_id") * 7, F.lit(" MIM:3 "), F.substring("text", 1, 40))
    u = F.concat(F.lit("it causes SCID-"), "item_id", F.lit(" often"))
    x = table(spark, d, "benchmark").select("item_id", s.alias("s"), u.alias("u"))
    return x.select("item_id", t.mim_ids(F.col("s")).alias("ids"), t.disease_label(F.col("s")).alias("label"), t.disease_label(F.col("u")).alias("cause"), t.disease_node(t.disease_label(F.col("s")), t.mim_ids(F.col("s"))).alias("node"))


@query("p13_stable_id", "select o_orderkey, case when o_orderkey % 2 = 0 then 'R-HSA-' || o_orderkey when o_orderkey % 3 = 0 then 'R-HSA-x' end id from orders")
def p13(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", t.stable_id(F.when(k % 2 == 0, k.cast("string")).otherwise("n/a"), F.when(k % 3 == 0, "R-HSA-x").otherwise("else")).alias("id"))


@query("p15_p16_identifiers", "select p_partkey, split_part(p_brand || ':' || p_partkey || ':x', ':', 1) db, p_partkey || ':x' as value, case when p_partkey % 2 = 0 then p_name when p_partkey % 3 = 0 then p_type end xref from part")
def p15(spark, d):
    k = F.col("p_partkey")
    db, value = t.split_id(F.concat("p_brand", F.lit(":"), k, F.lit(":x")))
    one = lambda a, b: F.struct(F.lit(a).alias("db_name"), F.col(b).alias("db_id"))
    none = F.struct(F.lit("Other").alias("db_name"), F.col("p_brand").alias("db_id"))
    refs = F.when(k % 2 == 0, F.array(none, one("Main", "p_name"))).when(k % 3 == 0, F.array(one("Main v1", "p_brand"), one("Main v2", "p_type"), none)).otherwise(F.array(none))
    return table(spark, d, "part").select("p_partkey", db.alias("db"), value.alias("value"), t.xref_value(refs, "Main", "Main").alias("xref"))


@query("p17_p19_sequences", r"select doc_id, case when length(regexp_replace(upper(text), '[^ACGTU]', '', 'g')) / greatest(length(text), 1) > 0.2 then 'dna' else 'protein' end kind, round((length(text) - length(replace(upper(text), 'A', ''))) / greatest(length(text), 1), 6) share_a, round((length(text) - length(replace(upper(text), 'Y', ''))) / greatest(length(text), 1), 6) share_y from (select doc_id, regexp_replace(text, '[^\x01-\x7f]', '', 'g') as text from documents)")
def p17(spark, d):
    a = t.amino_shares(F.col("text"))
    x = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^\\x01-\\x7f]", "").alias("text"))
    return x.select("doc_id", t.sequence_type(F.col("text"), 0.2).alias("kind"), F.round(a[t.AMINO_ACIDS.index("A")], 6).alias("share_a"), F.round(a[t.AMINO_ACIDS.index("Y")], 6).alias("share_y"))


@query("p18_kmers", "with x as (select doc_id, replace(upper(text), 'U', 'T') s from documents), k as (select doc_id, substr(s, i::int, 4) k from (select doc_id, s, unnest(range(1, length(s) - 2)) i from x)) select k, count(*)::bigint n, count(distinct doc_id)::bigint docs from k where regexp_full_match(k, '[ACGT]{4}') group by k")
def p18(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.explode(t.kmers(F.col("text"))).alias("k"))
    return x.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("p20_resize", "select vec_id, len(r) n, round(list_sum(r), 4) total from (select vec_id, list_resize(embedding, case when vec_id % 2 = 0 then 16 else 100 end, 0)::double[] r from embeddings)")
def p20(spark, d):
    e = table(spark, d, "embeddings")
    r = F.when(F.col("vec_id") % 2 == 0, t.resize(F.col("embedding"), 16)).otherwise(t.resize(F.col("embedding"), 100))
    return e.select("vec_id", F.size(r).alias("n"), F.round(F.aggregate(r, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("p21_time_encoding", "select event_id, list_transform(range(8), lambda i: round(cos((event_id % 100) * pow(10.0, -9.0 * i / 7)), 6)) enc from events")
def p21(spark, d):
    return table(spark, d, "events").select("event_id", F.transform(t.time_encoding(F.col("event_id") % 100, 8), lambda x: F.round(x, 6)).alias("enc"))


@query("p22_p23_p24_names", "select page_id, lower(regexp_replace(url, '[^\\w]', '_', 'g')) cache, url || '::reaction' as edge, case when length(url) > 20 then substr(url, 1, 17) || '...' else url end short from pages")
def p22(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", t.cache_name(u).alias("cache"), t.hyperedge_name(u, "reaction").alias("edge"), t.shorten(u, 20).alias("short"))


@query("s20_fasta", "select item_id, regexp_replace(text, '\\s', '', 'g') sequence from benchmark")
def s20(spark, d):
    b = table(spark, d, "benchmark").select(F.concat(F.lit(">sp|"), "item_id", F.lit("|NAME\n"), F.replace("text", F.lit(">"), F.lit("")), F.lit("\n>sp|"), F.col("item_id") + 1000000, F.lit("|X\nAC\nGT")).alias("p"))
    x = b.select(F.inline(t.fasta_records(F.col("p"), t.UNIPROT_ID)))
    return x.select(F.col("id").cast("long").alias("item_id"), "sequence").where("item_id < 1000000")


@query("s21_smiles", "select p_partkey, case when p_partkey % 4 < 3 then p_name end smiles from part")
def s21(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    payload = F.when(k == 0, F.concat(F.lit('{"default_structure":{"smiles":"'), n, F.lit('"}}'))).when(k == 1, F.concat(F.lit('{"PC_Compounds":[{"props":[{"urn":{"label":"Mass","name":"Exact"},"value":{"sval":"1"}},{"urn":{"label":"SMILES","name":"Absolute"},"value":{"sval":"'), n, F.lit('"}}]}]}'))).when(k == 2, F.concat(F.lit('{"structuralData":{"smiles":"'), n, F.lit('"}}'))).otherwise(F.lit("{}"))
    return table(spark, d, "part").select("p_partkey", t.smiles(payload).alias("smiles"))


@query("s21_event_payload", "select (props->>'k')::bigint k, count(*)::bigint n from events group by 1")
def s21e(spark, d):
    return table(spark, d, "events").groupBy(F.from_json("props", "k bigint").getField("k").alias("k")).agg(F.count("*").alias("n"))


_R = """l as (select o_orderkey reaction, l_linenumber pos, p_name as name, p_brand as location, p_partkey id from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_linenumber <= 3),
r as (select o_orderkey reaction, l_linenumber pos, p_name as name, p_type as location, p_brand, p_size, p_partkey id from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_linenumber > 1)"""


def sides(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    left = x.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("reaction"), F.col("l_linenumber").alias("pos"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.lit("in")).otherwise("out").alias("location"), F.lit("protein").alias("kind"), F.col("p_partkey").alias("id"), (F.col("p_size") % 4 > 0).alias("dna"))
    right = x.where("l_linenumber > 1").select(F.col("l_orderkey").alias("reaction"), F.col("l_linenumber").alias("pos"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, F.lit("in")).otherwise("out").alias("location"), F.when(F.col("p_size") % 11 == 0, F.lit("other")).otherwise("protein").alias("kind"), F.col("p_partkey").alias("id"))
    return left, right


_SIDES = """x as (select l_orderkey reaction, l_linenumber pos, p_name as name, p_size, p_partkey id from lineitem join part on l_partkey = p_partkey),
l as (select *, case when p_size % 2 = 0 then 'in' else 'out' end as location, p_size % 4 > 0 dna from x where pos <= 3), r as (select *, case when p_size % 3 = 0 then 'in' else 'out' end as location, case when p_size % 11 = 0 then 'other' else 'protein' end kind from x where pos > 1)"""


@query("r01_translocations", f"with {_SIDES}, w as (select reaction, name, arg_max(location, (pos, location)) was from l group by all) select reaction from r join w using (reaction, name) where kind = 'protein' group by reaction having avg((was <> location)::int) > 0.5")
def r01(spark, d):
    left, right = sides(spark, d)
    return reactions.translocations(left.withColumn("pos", F.struct("pos", "location")), right)


@query("r02_r04_kinds", f"with {_SIDES}, w as (select reaction, name, arg_max(location, (pos, location)) was from l group by all), tr as (select reaction from r join w using (reaction, name) where kind = 'protein' group by reaction having avg((was <> location)::int) > 0.5), a as (select reaction, count(*) n, avg(dna::int) dna from l group by reaction), b as (select reaction, count(*) m, avg((kind = 'protein')::int) made from r group by reaction), bc as (select reaction from a join b using (reaction) where n <= 3 and dna > 0.5 and made > 0.8 and m >= 5 * n and m > 5) select o_orderkey reaction, case when o_orderkey in (from tr) then 'translocation' when o_orderkey in (from bc) then 'broadcast' else 'reaction' end kind from orders")
def r02(spark, d):
    left, right = sides(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("reaction"))
    return reactions.kinds(o, reactions.translocations(left.withColumn("pos", F.struct("pos", "location")), right), reactions.broadcasts(left, right))


@query("r03_translocation_pairs", f"with {_SIDES}, w as (select reaction, name, arg_max(id, (pos, id)) as \"right\" from r where kind = 'protein' group by all) select reaction, pos, id as \"left\", \"right\" from l join w using (reaction, name)")
def r03(spark, d):
    left, right = sides(spark, d)
    return reactions.pairs(left, right.withColumn("pos", F.struct("pos", "id")))


@query("d01_name_index", "select distinct lower(trim(p_name)) as key, 'n' || p_partkey as label from part union select lower(trim(p_brand)), 'n' || p_partkey from part where p_size % 2 = 0")
def d01(spark, d):
    n = table(spark, d, "part").select(F.concat(F.lit("n"), "p_partkey").alias("label"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("aliases"))
    return overlay.name_index(n)


@query("d04_reaction_disease", "with p as (select n_nationkey k, n_name disease, n_nationkey % 5 = 0 root from nation), m as (select l_suppkey % 25 k, l_orderkey reaction from lineitem) select reaction, coalesce(arg_max(disease, k) filter (where not root), arg_min(disease, k) filter (where root)) disease from m join p using (k) group by reaction")
def d04(spark, d):
    p = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pathway"), F.col("n_name").alias("disease"), F.col("n_nationkey").alias("doc_order"), (F.col("n_nationkey") % 5 == 0).alias("is_root"))
    return overlay.diseases(p, table(spark, d, "lineitem").select((F.col("l_suppkey") % 25).alias("pathway"), F.col("l_orderkey").alias("reaction")))


@query("d08_resolution", "with q as (select p_partkey query, case when p_partkey % 3 = 0 then p_partkey % 40 end db_id, case p_partkey % 4 when 0 then upper(n_name) when 1 then substr(n_name, 1, 8) else p_brand || 'zz' end as name from part join nation on p_partkey % 25 = n_nationkey), i as (select n_nationkey db_id, 'i' || n_nationkey as label from nation), k as (select lower(n_name) as key, 'k' || min(n_nationkey) as label from nation group by 1), a as (select query, label, 'id' how from q join i using (db_id)), r as (select *, lower(name) as key from q where query not in (select query from a)), b as (select query, label, 'name' how from r join k using (key)), s as (select * from r where query not in (select query from b)), c as (select query, arg_min(k.label, k.key) as label, 'part' how from s join k on contains(k.key, s.key) or contains(s.key, k.key) group by query) from a union all from b union all from c")
def d08(spark, d):
    n = table(spark, d, "nation")
    p = table(spark, d, "part").join(n, F.col("p_partkey") % 25 == F.col("n_nationkey"))
    k = F.col("p_partkey")
    q = p.select(k.alias("query"), F.when(k % 3 == 0, (k % 40).cast("int")).alias("db_id"), F.when(k % 4 == 0, F.upper("n_name")).when(k % 4 == 1, F.substring("n_name", 1, 8)).otherwise(F.concat("p_brand", F.lit("zz"))).alias("name"))
    ids = n.select(F.col("n_nationkey").alias("db_id"), F.concat(F.lit("i"), "n_nationkey").alias("label"))
    names = n.select(F.lower("n_name").alias("key"), F.concat(F.lit("k"), "n_nationkey").alias("label"))
    return overlay.resolve(q, ids, names)


def overlay_tables(spark, d):
    o = table(spark, d, "orders")
    r = o.select(F.col("o_orderkey").alias("reaction"), (F.col("o_orderkey") % 2).alias("n_products"), F.concat(F.lit("[DISEASE] "), "o_orderpriority").alias("disease"), (F.col("o_orderkey") * 3).alias("time"))
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("reaction"), "l_suppkey", "l_partkey", "l_linenumber")
    b = x.where("l_linenumber <= 2").select("reaction", F.concat(F.lit("s"), "l_suppkey").alias("branch")).distinct()
    v = x.where("l_linenumber in (2, 3)").select("reaction", F.concat(F.lit("[MUT] "), "l_partkey").alias("variant")).distinct()
    p = x.where("l_linenumber = 4").select("reaction", F.concat(F.lit("p"), "l_partkey").alias("product")).distinct()
    return r, b, v, p


_O = """r as (select o_orderkey reaction, o_orderkey % 2 n_products, '[DISEASE] ' || o_orderpriority disease, o_orderkey * 3 as time from orders),
b as (select distinct l_orderkey reaction, 's' || l_suppkey branch from lineitem where l_linenumber <= 2), v as (select distinct l_orderkey reaction, '[MUT] ' || l_partkey variant from lineitem where l_linenumber in (2, 3)),
p as (select distinct l_orderkey reaction, 'p' || l_partkey product from lineitem where l_linenumber = 4), x as (select * from r where reaction in (select reaction from b))"""


@query("d13_loss_of_function", f"with {_O} select branch src, variant dst, 'disease_branch' as type, null::varchar subtype, time, reaction from x join b using (reaction) join v using (reaction) where n_products = 0 union all select variant, disease, 'loss_of_function', null, time + 1, reaction from x join v using (reaction) where n_products = 0")
def d13(spark, d):
    r, b, v, _ = overlay_tables(spark, d)
    return overlay.loss_edges(r, b, v)


@query("d14_gain_of_function", f"with {_O}, y as (select * from x where n_products > 0) select branch src, product dst, 'reaction' as type, 'disease' subtype, time, reaction from y join b using (reaction) join p using (reaction) union all select variant, branch, 'catalysis', 'disease_aberrant', time, reaction from y join v using (reaction) join b using (reaction) union all select variant, disease, 'aberrant_product', null, time + 1, reaction from y join v using (reaction) union all select product, disease, 'disease_progression', null, time + 2, reaction from y join p using (reaction)")
def d14(spark, d):
    return overlay.gain_edges(*overlay_tables(spark, d))


@query("d10_unanchored", f"with {_O} select reaction from r where reaction not in (select reaction from b)")
def d10(spark, d):
    r, b, _, _ = overlay_tables(spark, d)
    return overlay.unanchored(r, b).select("reaction")


@query("d11_first_writer", "select o_orderpriority as label, arg_min(o_orderkey, o_orderkey) reaction, arg_min(o_orderstatus, o_orderkey) status from orders group by 1")
def d11(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("reaction"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"))
    return overlay.by_first(x, "label", "seq")

def staged_overlay(spark, d):
    """Orders as disease reactions: left are suppliers (nodes of the healthy graph, but for every fourth) and a mutant of every second order; every
    third customer's group of two is a catalyst; products are the parts of every fifth order, whose labels only the healthy file has."""
    o, x, c, s, p = (table(spark, d, n) for n in ("orders", "lineitem", "customer", "supplier", "part"))
    k = F.col("o_orderkey")
    none = lambda kind="string": F.lit(None).cast(kind)
    arr = "array<string>"
    r = o.select(k.alias("reaction"), F.concat(F.lit("order "), k).alias("name"), F.array(F.concat(F.lit("see MIM:"), F.col("o_custkey") % 50)).alias("comments"), F.col("o_orderpriority").alias("disease"), F.array(F.lit("1")).alias("pathway_omim"), k.alias("step_key"))
    lefts = x.select(F.col("l_orderkey").alias("reaction"), F.concat(F.lit("s"), "l_suppkey").alias("id")).distinct().unionByName(o.where(k % 2 == 0).select(k.alias("reaction"), F.concat(F.lit("m"), k).alias("id")))
    rights = x.where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("reaction"), F.concat(F.lit("p"), "l_partkey").alias("id")).distinct()
    cats = o.where("o_custkey % 3 = 0").select(k.alias("reaction"), F.concat(F.lit("g"), "o_custkey").alias("id"))

    def rows(df, id_, source, store, label=None, members=None, mod=False):
        own = (none(), none(), F.array().cast(arr), F.array().cast(arr), F.array().cast(arr), members if members is not None else F.array().cast(arr), F.array().cast(arr), F.lit(False), F.lit(mod))
        names = ("db_id", "uniprot", "omim", "mutations", "clingen", "members", "components", "is_complex", "has_mod")
        return df.select(id_.alias("id"), F.lit(source).alias("source"), F.lit(store).alias("store"), id_.alias("name"), (label if label is not None else id_).alias("label"), *(v.alias(n) for v, n in zip(own, names)))

    cust = c.where("c_custkey % 3 = 0")
    v = lambda mark: F.concat(F.lit(mark), "c_custkey")
    entities = rows(s, F.concat(F.lit("s"), "s_suppkey"), 0, 0).unionByName(rows(o.where(k % 2 == 0), F.concat(F.lit("m"), k), 0, 0, mod=True))
    entities = entities.unionByName(rows(cust, v("g"), 0, 4, members=F.array(v("v"), v("w")))).unionByName(rows(cust, v("v"), 0, 0)).unionByName(rows(cust, v("w"), 1, 0)).unionByName(rows(cust, v("v"), 1, 0, label=F.lit("hidden")))
    entities = entities.unionByName(rows(p, F.concat(F.lit("p"), "p_partkey"), 1, 0, label=F.concat(F.lit("part "), "p_partkey")))
    nodes = s.where("s_suppkey % 4 > 0").select(F.concat(F.lit("N"), "s_suppkey").alias("label"), F.concat(F.lit(" S"), "s_suppkey").alias("name"), none().alias("db_id"), none(arr).alias("aliases"))
    return r, lefts, rights, cats, entities, nodes


_V = """r as (select o_orderkey reaction, 1000 + row_number() over (order by o_orderkey) as time, '[DISEASE] ' || o_orderpriority || ' (OMIM:' || case when o_custkey % 3 = 0 or o_orderkey % 2 = 0 then 1 else o_custkey % 50 end || ')' disease, o_custkey % 3 = 0 cat, o_custkey, o_orderkey % 2 = 0 mut, o_orderkey % 5 = 0 gain from orders),
b as (select distinct l_orderkey reaction, 'N' || l_suppkey branch from lineitem where l_suppkey % 4 > 0),
x as (select * from r where reaction in (select reaction from b)),
v as (select reaction, '[MUT] ' || unnest(case when cat then ['v' || o_custkey, 'w' || o_custkey] when mut then ['m' || reaction] else ['order ' || reaction] end) variant from x),
p as (select distinct l_orderkey reaction, 'part ' || l_partkey product from lineitem where l_orderkey % 5 = 0)"""


@query("d09_d16_overlay_edges", f"with {_V} select branch src, variant dst, 'disease_branch' as type, null::varchar subtype, time, reaction from x join b using (reaction) join v using (reaction) where not gain union all select variant, disease, 'loss_of_function', null, time + 1, reaction from x join v using (reaction) where not gain union all select branch, product, 'reaction', 'disease', time, reaction from x join b using (reaction) join p using (reaction) union all select variant, branch, 'catalysis', 'disease_aberrant', time, reaction from x join v using (reaction) join b using (reaction) where gain union all select variant, disease, 'aberrant_product', null, time + 1, reaction from x join v using (reaction) where gain union all select product, disease, 'disease_progression', null, time + 2, reaction from x join p using (reaction)")
def d09(spark, d):
    out = disease.apply(*staged_overlay(spark, d), base=1000, fuzzy=False).edges
    return out.select("src", "dst", "type", "subtype", F.col("time").cast("long").alias("time"), "reaction")


@query("m11_variant_ends", "with c as (select c_custkey k from customer where c_custkey % 3 = 0) select 'g' || k root, unnest(['v' || k, 'w' || k]) node from c")
def m11(spark, d):
    *_, cats, entities, _ = staged_overlay(spark, d)
    groups = entities.where("store = 4").select("id")
    return disease.variants(groups, entities).select("root", "node")


@query("m12_end_labels", "select 'p' || p_partkey root, 'part ' || p_partkey as label from part union all select 's' || s_suppkey, 's' || s_suppkey from supplier union all select 'g' || c_custkey, 'v' || c_custkey from customer where c_custkey % 3 = 0")
def m12(spark, d):
    *_, entities, _ = staged_overlay(spark, d)
    roots = entities.where("substring(id, 1, 1) in ('p', 's', 'g')").select("id").distinct()
    return disease.end_labels(roots, entities).select("root", "label")


@query("d02_pathway_diseases", "select page_id pathway, case when page_id % 3 = 0 then 'vocab ' || page_id when page_id % 3 = 1 then 'Name ' || page_id else url end disease, case when page_id % 3 = 0 then ['5'] when page_id % 3 = 1 then [(page_id + 100)::varchar, 'x' || page_id] else ['x' || page_id] end omim from pages")
def d02(spark, d):
    k = F.col("page_id")
    one = lambda db, value: F.struct(F.lit(db).alias("db"), value.cast("string").alias("id"))
    x = table(spark, d, "pages").select(
        k.alias("pathway"), F.col("url").alias("display"), F.when(k % 3 == 1, F.array(F.lit("first"), F.concat(F.lit("(Name "), k, F.lit("; MIM:"), k + 100, F.lit(") mim:"), k + 100))).alias("comments"),
        F.when(k % 3 == 0, F.concat(F.lit("vocab "), k)).alias("vocabulary"), F.when(k % 3 == 0, F.array(F.lit("5"), F.lit("5"))).alias("vocabulary_omim"),
        F.when(k % 3 > 0, F.array(one("ChEBI", k), one("MONDO", F.concat(F.lit("x"), k)), one("OMIM", F.lit("")))).alias("xrefs"),
    )
    return disease.mined(x)
