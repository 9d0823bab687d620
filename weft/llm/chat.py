"""Operator 6, chat formatting by a finite-state machine over roles. DataFrame functions only.

A declarative template names the control strings, the roles that carry loss, the allowed transitions and the states in
which a conversation may end. Turns are put in order, the machine walks the roles and reports the first bad turn, and
each turn becomes three segments: opening control string, escaped text, closing control string, each with a loss flag.
No conversation is dropped: a bad order is reported in `valid` and `bad_turn`.

Escaping replaces the characters the control strings are made of, so none can appear in a text; unescaping is exact.

Defined results: a null text or role is empty; rows with a null conv_id form one conversation; turns order by (turn, role,
text), null turns first, so ties and repeated rows have one order and each is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "<s>[{role}] "
    close: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: State (the last role, or start) to the roles that may follow.
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accept: tuple[str, ...] = ("assistant",)
    #: Characters of the control strings and the escapes that stand for them; & comes first.
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lb;"), ("]", "&rb;"))


DEFAULT = Template()


def escape(c: Column, t: Template = DEFAULT) -> Column:
    for raw, safe in t.escapes:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, t: Template = DEFAULT) -> Column:
    for raw, safe in reversed(t.escapes):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_chats(rows: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, segments (array of text, loss), valid, bad_turn (position from 0 of the first turn the machine rejects, the number of turns if it ends in a wrong state, else null)."""
    empty = F.lit("")
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("x"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    before, after = t.open.split("{role}")
    allowed = [(a, b) for a, bs in t.transitions.items() for b in bs]
    moves = F.array(*[F.lit(f"{a}\n{b}") for a, b in allowed])
    roles = F.transform("turns", lambda x: x["role"])
    bad = F.zip_with(F.slice(F.concat(F.array(F.lit("start")), roles), 1, F.size(roles)), roles, lambda a, b: ~F.array_contains(moves, F.concat(a, F.lit("\n"), b)))
    first_bad = F.array_position(bad, True)
    ends = F.element_at(roles, -1).isin(*t.accept)
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(F.concat(F.lit(before), escape(x["role"], t), F.lit(after)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
        F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
    )))
    out = chats.select("conv_id", segments.alias("segments"), F.when(first_bad > 0, first_bad - 1).when(~ends, F.size(roles).cast("long")).alias("bad_turn"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def read_turns(formatted: Column, t: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    before, after = t.open.split("{role}")
    parts = F.split(formatted, "\\Q" + t.close + "\\E")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(before) + 1)), after, 1), t).alias("role"),
        unescape(F.substr(p, F.locate(after, p) + len(after)), t).alias("text"),
    ))


def digest(chats: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """The contract's columns, from what format_chats put out."""
    x = chats.withColumn("_turns", read_turns(F.col("formatted"), t))
    x = x.withColumn("_loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), ""))
    said = F.array_join(F.transform("_turns", lambda y: F.concat(y["role"], F.lit("\n"), y["text"], F.lit("\n"))), "")
    return x.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn",
    )


def op6(spark, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select cast(-7 as bigint) conv_id, cast(i as bigint) turn, role, '{hard}' text from values (0, 'user'), (1, 'assistant') as t(i, role)")
    return digest(format_chats(rows.unionByName(more)))
