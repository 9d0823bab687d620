"""Pathway-exchange RDF/XML files as relations (survey section 2.1).

Every record kind is scanned by itself with the built-in XML source and an explicit schema, so only the fields that are used
are parsed. Stage the relations as Parquet before heavy use: an XML scan parses the whole file each time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as t

_REF = "struct<_resource:string>"
_REFS = f"array<{_REF}>"
_ENTITY = f"_ID string, displayName string, name array<string>, comment array<string>, cellularLocation {_REF}, xref {_REFS}, entityReference {_REF}, memberPhysicalEntity {_REFS}, component {_REFS}, componentStoichiometry {_REFS}, feature {_REFS}"
#: Record kinds in the order in which their stores are searched.
KINDS = {"Protein": "protein", "SmallMolecule": "small_molecule", "Dna": "dna", "Rna": "rna", "PhysicalEntity": "physical_entity", "Complex": "complex"}
REFERENCES = ("ProteinReference", "DnaReference", "RnaReference", "SmallMoleculeReference")
VOCABULARIES = ("DiseaseOntologyVocabulary", "MedicalOntologyVocabulary", "DiseaseTermVocabulary")
# Databases that carry disease ids.
DISEASE_DBS = ("omim", "mim", "mondo", "disease ontology", "do", "orpha", "orphanet", "medgen", "clinvar", "omim disease")


def scan(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """S01. Records of one kind with doc_order."""
    raw = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)
    return raw.withColumn("doc_order", F.monotonically_increasing_id())


def _ref(c: str) -> Column:
    return t.local_ref(F.col(c)["_resource"])


def _refs(c: str) -> Column:
    return F.transform(F.coalesce(c, F.array().cast(_REFS)), lambda r: t.local_ref(r["_resource"]))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Stores:
    entity: DataFrame
    reaction: DataFrame
    catalysis: DataFrame
    step: DataFrame
    pathway: DataFrame
    xref: DataFrame


def xrefs(spark: SparkSession, path: str) -> DataFrame:
    """S02, S14. id, db_name, db_id, kind."""
    return _union([scan(spark, path, tag, "_ID string, id string, db string").select(F.col("_ID").alias("id"), F.col("db").alias("db_name"), F.col("id").alias("db_id"), F.lit(tag).alias("kind")) for tag in ("UnificationXref", "RelationshipXref")])


def locations(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """S03. id, common_name, db_name, db_id. The first xref must resolve."""
    v = scan(spark, path, "CellularLocationVocabulary", f"_ID string, term array<string>, xref {_REFS}")
    v = v.select(F.col("_ID").alias("loc_id"), F.get("term", F.lit(0)).alias("common_name"), F.get(_refs("xref"), F.lit(0)).alias("id"))
    return v.join(refs.where("kind = 'UnificationXref'").select("id", "db_name", "db_id"), "id").select("loc_id", "common_name", "db_name", "db_id")


def references(spark: SparkSession, path: str) -> DataFrame:
    """S04. ref, identifier."""
    return _union([scan(spark, path, tag, "_ID string, name array<string>").select(F.col("_ID").alias("ref"), t.normal_id(F.get("name", F.lit(0))).alias("identifier")) for tag in REFERENCES])


def entities(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """S05 to S08. One table of all physical entities; label is the node they stand for."""
    parts = []
    for rank, (tag, kind) in enumerate(KINDS.items()):
        e = scan(spark, path, tag, _ENTITY)
        parts.append(e.select(
            F.col("_ID").alias("id"), F.lit(kind).alias("kind"), F.lit(rank).alias("store_rank"), "doc_order", t.display_name(F.col("displayName"), F.col("name"), F.col("_ID")).alias("name"),
            F.coalesce("name", F.array().cast("array<string>")).alias("aliases"), t.first_with_prefix(F.col("comment"), "Reactome DB_ID:").alias("db_id"),
            _ref("cellularLocation").alias("loc_id"), _ref("entityReference").alias("ref"), _refs("memberPhysicalEntity").alias("members"), _refs("component").alias("components"),
            _refs("xref").alias("xref_ids"), _refs("feature").alias("features"),
        ))
    e = _union(parts).join(locations(spark, path, refs), "loc_id", "left").join(references(spark, path), "ref", "left")
    return e.withColumn("label", t.label(F.col("name"), F.col("common_name"), F.col("members"))).withColumnRenamed("common_name", "location")


def catalyses(spark: SparkSession, path: str) -> DataFrame:
    """S09. reaction, control, controller: the last record of each controlled id."""
    c = scan(spark, path, "Catalysis", f"_ID string, controlType string, controller {_REF}, controlled {_REF}")
    c = c.select(_ref("controlled").alias("reaction"), F.coalesce("controlType", F.lit("ACTIVATION")).alias("control"), _ref("controller").alias("controller"), "doc_order")
    return c.groupBy("reaction").agg(F.max_by("control", "doc_order").alias("control"), F.max_by("controller", "doc_order").alias("controller"))


def stoichiometry(spark: SparkSession, path: str) -> DataFrame:
    """S10."""
    s = scan(spark, path, "Stoichiometry", f"_ID string, stoichiometricCoefficient string, physicalEntity {_REF}")
    return s.select(F.col("_ID").alias("id"), F.col("stoichiometricCoefficient").alias("coefficient"), F.col("physicalEntity")["_resource"].alias("entity"))


def pathways(spark: SparkSession, path: str) -> DataFrame:
    """S11. id, name, components, steps, doc_order."""
    p = scan(spark, path, "Pathway", f"_ID string, displayName string, pathwayComponent {_REFS}, pathwayOrder {_REFS}, comment array<string>, xref {_REFS}")
    return p.select(F.col("_ID").alias("id"), F.col("displayName").alias("name"), _refs("pathwayComponent").alias("components"), _refs("pathwayOrder").alias("steps"), "comment", "doc_order")


def steps(spark: SparkSession, path: str) -> DataFrame:
    """S12. id, reaction (the last process that is one), other processes, next steps."""
    s = scan(spark, path, "PathwayStep", f"_ID string, stepProcess {_REFS}, nextStep {_REFS}").withColumn("p", _refs("stepProcess"))
    is_reaction = lambda x: x.contains("BiochemicalReaction")
    return s.select(F.col("_ID").alias("id"), F.try_element_at(F.filter("p", is_reaction), F.lit(-1)).alias("reaction"), F.filter("p", lambda x: ~is_reaction(x)).alias("other"), _refs("nextStep").alias("next"), "doc_order")


def reactions(spark: SparkSession, path: str) -> DataFrame:
    """S13. Reactions that run from left to right; a record without a direction is left out."""
    r = scan(spark, path, "BiochemicalReaction", f"_ID string, displayName string, conversionDirection string, left {_REFS}, right {_REFS}, comment array<string>, xref {_REFS}")
    return r.where("conversionDirection = 'LEFT-TO-RIGHT'").select(F.col("_ID").alias("reaction"), F.col("displayName").alias("name"), _refs("left").alias("left"), _refs("right").alias("right"), "comment", _refs("xref").alias("xref_ids"), "doc_order")


def disease_terms(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """S15. id, term, db_name, db_id of vocabulary entries whose database carries disease ids."""
    v = _union([scan(spark, path, tag, f"_ID string, term array<string>, xref {_REFS}") for tag in VOCABULARIES])
    v = v.select(F.col("_ID").alias("term_id"), F.get("term", F.lit(0)).alias("term"), F.explode(_refs("xref")).alias("id"))
    return v.join(refs.select("id", "db_name", "db_id"), "id").where(F.lower("db_name").isin(*DISEASE_DBS)).select("term_id", "term", "db_name", "db_id")


def modifications(spark: SparkSession, path: str) -> DataFrame:
    """S16."""
    return scan(spark, path, "ModificationFeature", "_ID string").select(F.col("_ID").alias("feature"))


def stores(spark: SparkSession, path: str) -> Stores:
    refs = xrefs(spark, path)
    return Stores(entities(spark, path, refs), reactions(spark, path), catalyses(spark, path), steps(spark, path), pathways(spark, path), refs)
