"""The corpus pipeline: STAGES run one after the other, each over all rows its predecessor kept.

All stages but the last return the columns of `documents`. SQL cannot express the similarity join, the decontamination,
the classifier or the tokenizer, so there is no SQL; the tests hold every stage against brute force.
"""

from __future__ import annotations

from weft.llm import decontaminate, jaccard, mixing, quality, tokenids
from weft.llm.common import Scratch

#: Shares of the tokens that each domain is to have after mixing.
SHARES = {"clean": 0.97, "junk": 0.01, "toxic": 0.02}


def quality_rules(spark, docs, sf_dir):
    """Documents that the standard policy rejects go."""
    return quality.filter_documents(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near-copies stays: shingles of five words, Jaccard 0.8 or more, the least id."""
    return jaccard.one_per_class(spark, docs, 5, 80, 100)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark, docs, sf_dir):
    """Documents are drawn at the rates that bring the domains to SHARES of the tokens there are."""
    rates = mixing.mix(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), SHARES)
    return mixing.draw(docs, rates)


def token_output(spark, docs, sf_dir):
    """Token ids are written to files and read back: doc_id, start, n_tokens, ids_crc32 of each row."""
    return tokenids.round_trip(spark, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing_sources),
    ("token ids", token_output),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """STAGES applied to `documents`; between two stages the rows are written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
