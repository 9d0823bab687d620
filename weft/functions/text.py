"""Scalar rules over names, references, sequences and vectors, as Column expressions (survey section 2.2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules' patterns and word lists.
BRACKET_ID = r"\[([^:]+):(\S+)\]"
PREFIX_ID = r"^(.+?):(\S+)"
VARIANT_NAME = r"(?i)(?:^|[\s_-])[A-Z]\d+(?:\*|[A-Z]|del|ins|dup|fs|Ter|TER|X\b)"
VARIANT_WORDS = "variant|mutant|defect"
DISEASE_NAME = r"\(([A-Za-z][^;)]{1,80});\s*MIM:\d+\)"
DISEASE_CAUSE = r"causes\s+([A-Z][A-Z0-9\-]{1,20})\b"
NUCLEOTIDES = "ACGTU"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def normal_id(name: Column) -> Column:
    """P01. `x [DB:ID]` and `DB:ID rest` become `DB:ID`; other text stays; null stays null."""
    t = F.trim(name)
    pick = lambda p: F.concat(F.regexp_extract(t, p, 1), F.lit(":"), F.regexp_extract(t, p, 2))
    return F.when(t.rlike(BRACKET_ID), pick(BRACKET_ID)).when(t.rlike(PREFIX_ID), pick(PREFIX_ID)).otherwise(t)


def local_ref(ref: Column) -> Column:
    """P02. A reference without the # at its ends."""
    return F.btrim(ref, F.lit("#"))


def display_name(display: Column, names: Column, id_: Column) -> Column:
    """P03."""
    return F.coalesce(display, F.get(names, F.lit(0)), id_)


def first_with_prefix(comments: Column, prefix: str) -> Column:
    """P04. The rest of the first comment that begins with the prefix."""
    found = F.get(F.filter(comments, lambda c: c.startswith(prefix)), F.lit(0))
    return F.trim(F.replace(found, F.lit(prefix), F.lit("")))


def label(name: Column, location: Column, members: Column | None = None) -> Column:
    """P05. `[OR] ` for a group with members, then the name, then the location in brackets unless null or empty."""
    prefix = F.lit("") if members is None else F.when(F.coalesce(F.size(members), F.lit(0)) > 0, "[OR] ").otherwise("")
    return F.concat(prefix, name, F.when(F.coalesce(location, F.lit("")) != "", F.concat(F.lit(" ["), location, F.lit("]"))).otherwise(""))


def is_variant_name(name: Column) -> Column:
    """P09."""
    return F.coalesce(name.rlike(VARIANT_NAME), F.lit(False))


def is_variant_group(name: Column, members: Column, words: str = VARIANT_WORDS) -> Column:
    """P10."""
    return (F.coalesce(F.size(members), F.lit(0)) > 0) & F.coalesce(F.lower(name).rlike(words), F.lit(False))


def mim_ids(text: Column, any_case: bool = False) -> Column:
    """P11. Numbers after MIM:, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(("(?i)" if any_case else "") + r"MIM:(\d+)"), 1))


def disease_label(text: Column) -> Column:
    """P12. `(Name; MIM:n)` first, else `causes ABC`; null if neither is there."""
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(F.trim(F.regexp_extract(text, DISEASE_NAME, 1))), blank(F.regexp_extract(text, DISEASE_CAUSE, 1)))


def stable_id(number: Column, id_: Column, prefix: str = "R-HSA-") -> Column:
    """P13."""
    return F.when(number.rlike(r"^\d+$"), F.concat(F.lit(prefix), number)).when(id_.startswith(prefix), id_)


def disease_node(name: Column, omim: Column) -> Column:
    """P14. Label of a disease node with its first number."""
    first = F.get(omim, F.lit(0))
    return F.concat(F.lit("[DISEASE] "), name, F.when(first.isNotNull(), F.concat(F.lit(" (OMIM:"), first, F.lit(")"))).otherwise(""))


def split_id(identifier: Column) -> tuple[Column, Column]:
    """P15. Database and value of `DB:ID`, cut at the first colon."""
    parts = F.split(identifier, ":", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def xref_value(xrefs: Column, exact: str, start: str) -> Column:
    """P16. The first xref whose database is `exact`, else the last whose database begins with `start`."""
    a = F.get(F.filter(xrefs, lambda x: x["db_name"] == exact), F.lit(0))["db_id"]
    some = F.filter(xrefs, lambda x: x["db_name"].startswith(start))
    return F.coalesce(a, F.try_element_at(some, F.lit(-1))["db_id"])


def sequence_type(seq: Column, share: float = 0.8) -> Column:
    """P17."""
    hits = F.length(F.regexp_replace(F.upper(seq), f"[^{NUCLEOTIDES}]", ""))
    return F.when(hits / F.greatest(F.length(seq), F.lit(1)) > share, "dna").otherwise("protein")


def kmers(seq: Column, k: int = 4) -> Column:
    """P18. All windows of k letters ACGT (U read as T); windows with other letters are left out. Explode and count for frequencies."""
    t = F.replace(F.upper(seq), F.lit("U"), F.lit("T"))
    return F.regexp_extract_all(t, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def amino_shares(seq: Column) -> Column:
    """P19. Share of each amino acid in the text's full length."""
    t = F.upper(seq)
    return F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(a), F.lit("")))) / F.greatest(F.length(t), F.lit(1)) for a in AMINO_ACIDS])


def resize(v: Column, n: int) -> Column:
    """P20. Cut or zero-padded to n."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def time_encoding(t: Column, d: int) -> Column:
    """P21."""
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.cos(t * F.pow(F.lit(10.0), i * F.lit(-9.0 / max(d - 1, 1)))))


def cache_name(db: Column) -> Column:
    """P22."""
    return F.lower(F.regexp_replace(db, r"[^\w]", "_"))


def hyperedge_name(reaction: Column, part: str) -> Column:
    """P23."""
    return F.concat(reaction, F.lit(f"::{part}"))


def shorten(text: Column, n: int) -> Column:
    """P24. At most n characters, the last three of them dots where it was longer."""
    return F.when(F.length(text) > n, F.concat(F.substr(text, F.lit(1), F.lit(n - 3)), F.lit("..."))).otherwise(text)


def fasta_records(payload: Column, id_pattern: str) -> Column:
    """S20. (id, sequence) of each record of a FASTA text."""
    records = F.filter(F.split(F.concat(F.lit("\n"), payload), "\n>"), lambda r: F.trim(r) != "")
    return F.transform(records, lambda r: F.struct(F.regexp_extract(r, id_pattern, 1).alias("id"), F.regexp_replace(F.regexp_replace(r, r"^[^\n]*", ""), r"\s", "").alias("sequence")))


UNIPROT_ID = r"^[^|\n]*\|([^|\n]*)\|"
FIRST_TOKEN = r"^(\S+)"


def smiles(payload: Column) -> Column:
    """S21. The SMILES text of a payload of any of the three chemistry services."""
    props = F.from_json(F.get_json_object(payload, "$.PC_Compounds[0].props"), "array<struct<urn:struct<label:string,name:string>,value:struct<sval:string>>>")
    absolute = F.get(F.filter(props, lambda p: (p["urn"]["label"] == "SMILES") & (p["urn"]["name"] == "Absolute")), F.lit(0))["value"]["sval"]
    return F.coalesce(F.get_json_object(payload, "$.default_structure.smiles"), absolute, F.get_json_object(payload, "$.smiles"), F.get_json_object(payload, "$.structuralData.smiles"))
