"""Operator 2, quality rules as a bitmask ledger. DataFrame functions only.

Every rule is evaluated once per document; the ledger stores the measurements and one failure bit per rule. A policy is
a versioned mask over those bits, so applying or changing policies and computing ablations are bitwise operations on the
ledger and never touch a text again.

Defined results: a null or empty text has no words, so every count is 0 and the rule `short` fails; a null doc_id and
repeated rows pass through as they are, row by row; an empty table gives an empty ledger; other columns are ignored.
Windows within one text are compared by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL condition over the measurements


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


#: Bits are never reused: a changed rule gets a new bit, so that old ledgers keep their meaning.
RULES = (
    Rule(0, "short", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 3 * n_words or word_chars > 12 * n_words)"),
    Rule(5, "exclamations", "10 * n_exclaims > 3 * n_words"),
)
BASE = Policy("base", 1, ("short", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(r.name for r in RULES))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")


def _tail(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def measure(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id and MEASURES of each row, and with whole the row itself as _row. Arrays stay inside their row: nothing is shuffled."""
    t = F.coalesce("text", F.lit(""))
    row = ["_row"] if whole else []
    d = docs.select("doc_id", t.alias("_t"), *[F.struct(*[docs[c] for c in docs.columns]).alias(x) for x in row])
    squeezed = F.regexp_replace("_t", "[\\x20\\x09-\\x0D]+", "")
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""))
    d = d.withColumn("_h", F.transform(words_of(F.col("_t")), lambda w: F.xxhash64(w)))
    d = d.select(
        "doc_id",
        F.size("_h").cast("long").alias("n_words"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        "_h", *row,
    )
    m = F.greatest(F.size("_h") - 2, F.lit(0))
    triples = F.zip_with(F.zip_with(F.slice("_h", 1, m), F.slice("_h", 2, m), lambda a, b: F.xxhash64(a, b)), F.slice("_h", 3, m), lambda a, b: F.xxhash64(a, b))
    d = d.withColumn("_s", F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_e", F.zip_with("_s", _tail(F.col("_s")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    twice = F.zip_with("_e", F.concat(F.array(F.lit(False)), "_e"), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    found = F.filter(F.zip_with("_s", twice, lambda s, x: F.when(x, s["i"])), lambda i: i.isNotNull())
    d = d.withColumn("_p", F.sort_array(found))
    covered = F.aggregate(F.zip_with("_p", _tail(F.col("_p")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda x, y: x + y)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_lines", "n_exclaims", *row)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, whole: bool = False) -> DataFrame:
    """doc_id, the measurements, and fail_bits with bit r.bit set for each rule r that fails (and with whole the row as _row)."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, whole).withColumn("fail_bits", bits)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bit = {r.name: 1 << r.bit for r in rules}
    return sum(bit[n] for n in policy.rules)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of the ledger passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that fail it alone, and rows kept with the rule taken out.

    The ledger is first aggregated to one row per distinct bitmask (at most 2 to the number of rules).
    """
    m = mask(policy, rules)
    sets = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    one = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in policy.rules]
    x = sets.select("bits", "n", F.inline(F.array(*one)))
    hit = F.col("bits").bitwiseAND(F.col("bit"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return x.groupBy("rule").agg(total(hit != 0).alias("n_failed"), total(F.col("bits") == F.col("bit")).alias("n_failed_alone"), total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"))


def filter_documents(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of docs that pass the policy, all their columns. Every row is judged by itself, where it is.

    A filter would be pushed below the measurements and evaluate them again for each rule; a generator stays above them.
    """
    return ledger(docs, whole=True).select(F.inline(F.when(passes(policy), F.array("_row"))))


def op2(spark, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), passes(STANDARD).alias("kept"), "fail_bits", "n_lines", "n_exclaims",
    )
