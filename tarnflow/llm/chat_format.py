"""Preference formatting: conversations that open alike become a prompt and two masked completions.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once, as the
prompt; what follows is rendered for either side with the spans that a loss counts, the assistant's.
Turn marks in texts and roles are escaped, so that no text can pass for a turn. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import materialize

LEARNT = "assistant"


def escape(text: Column) -> Column:
    """A text (null: empty) with a backslash more between '<' and '|', wherever they meet or stand about backslashes: ``<|`` never remains, and one less undoes it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def gather_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation's ``role, text``, escaped, in order of turn, role and text. A null role or text is empty; turns without a conversation are left out."""
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), escape(F.col(role_col)).alias("role"), escape(F.col(text_col)).alias("text")).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share before the first that differs or is missing."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def render(turns: Column) -> Column:
    """Turns as text: a head with the role, the text, an end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def learnt_spans(turns: Column, role: str = LEARNT) -> Column:
    """``start:end`` of the assistant's texts with their end marks in ``render(turns)``, comma-joined; code points, end exclusive."""

    def put(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"]) + 7
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == role, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, put, lambda s: F.array_join(s["spans"], ","))


def format_pair(chosen: Column, rejected: Column) -> list[Column]:
    """``n_common, prompt, chosen, chosen_mask, rejected, rejected_mask`` of two columns of turns."""
    n = common_turns(chosen, rejected)
    rest = [F.slice(c, n + 1, F.greatest(F.size(c), F.lit(1))) for c in (chosen, rejected)]
    return [
        n.alias("n_common"), render(F.slice(chosen, 1, n)).alias("prompt"),
        render(rest[0]).alias("chosen"), learnt_spans(rest[0]).alias("chosen_mask"),
        render(rest[1]).alias("rejected"), learnt_spans(rest[1]).alias("rejected_mask"),
    ]


def format_preferences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, chosen_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask``: one row per conversation.

    Of conversations whose first turn is the same, that with the most characters by the assistant is
    chosen (ties: the smallest id). Each other one is a row with itself as the rejected side, unless its
    turns are all the same as the chosen one's. The chosen one, its copies and conversations that stand
    alone have no rejected side (null): the prompt is all before the assistant's last turn (before the
    end, if there is none), the completion the rest. Every pair has the chosen one, so pairs are no more
    than conversations. Null ids are left out; an empty table gives no rows; other columns are not read.
    """
    convs = gather_turns(turns, conv_col, turn_col, role_col, text_col)
    said = F.aggregate("turns", F.lit(0), lambda n, t: n + F.when(t["role"] == LEARNT, F.length(t["text"])).otherwise(0))
    first = F.element_at("turns", 1)
    convs = materialize(convs.select("conv_id", "turns", F.sha2(F.concat_ws("\n", first["role"], first["text"]), 256).alias("opening"), said.alias("said")), "conversations")
    best = convs.groupBy("opening").agg(F.max(F.struct("said", (-F.col("conv_id")).alias("minus"))).alias("best"))
    best = best.select((-F.col("best.minus")).alias("conv_id"))
    chosen = convs.join(best, "conv_id", "left_semi").select("opening", F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen_turns"))
    both = convs.join(chosen, "opening")
    pair = F.col("turns") != F.col("chosen_turns")
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"]), LEARNT).cast("int")
    head = F.when(last < F.size("turns"), last).otherwise(F.size("turns"))
    rest = F.slice("turns", head + 1, F.size("turns"))
    alone = [F.lit(None).cast("int"), render(F.slice("turns", 1, head)), render(rest), learnt_spans(rest), F.lit(None).cast("string"), F.lit(None).cast("string")]
    paired = format_pair(F.col("chosen_turns"), F.col("turns"))
    names = ["n_common", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    ids = ["conv_id", F.when(pair, F.col("chosen_id")).otherwise(F.col("conv_id")).alias("chosen_id")]
    return both.select(*ids, *[F.when(pair, p).otherwise(a).alias(n) for n, p, a in zip(names, paired, alone, strict=True)])
