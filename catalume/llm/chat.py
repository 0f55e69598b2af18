"""Preference formatting: shared turns once as the prompt, then two completions with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.llm.common import numbered


def _conversation(turns: DataFrame, name: str) -> DataFrame:
    """pair_id and the turns in order; ties of a turn by role, then text, nulls first."""
    t = F.struct("turn", "role", "text")
    return turns.groupBy("pair_id").agg(F.sort_array(F.collect_list(t)).alias(name))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _trained(turns: Column, roles: list[str]) -> Column:
    """Character spans of the rendered turns that count in the loss: texts, with their end, of the roles."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(_head(t))
        end = begin + F.length(_body(t))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(F.coalesce(t["role"].isin(roles), F.lit(False)), F.concat(a["spans"], span)).otherwise(a["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Turns (pair_id, turn, role, text) of both sides -> one row for each pair.

    Columns: pair_id, n_common (turns of the longest common prefix), prompt (these, rendered),
    chosen, rejected (the turns after it, rendered), chosen_mask, rejected_mask (spans of a
    completion, in characters, that are trained on: what the roles say).

    Turns are equal if role and text are (null equals null; the number of the turn may differ).
    A side without turns has an empty completion and the prompt is then empty. If one side is a
    prefix of the other, its completion is empty. Null roles and texts are rendered as empty.
    Repeated rows are repeated turns. Null pair_ids are one pair. Very long texts are carried as
    they are, other columns of either side are not looked at, and tables without rows give none.
    Each side is grouped by pair once, so that its turns come together; a pair is as large as its
    conversations.
    """
    c, r = _conversation(chosen, "c"), _conversation(rejected, "r")
    none = F.array().cast(c.schema["c"].dataType)
    x = c.join(r.withColumnRenamed("pair_id", "other_id"), F.col("pair_id").eqNullSafe(F.col("other_id")), "full")
    x = x.select(F.coalesce("pair_id", "other_id").alias("pair_id"), F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, shorter), F.slice("r", 1, shorter), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, False)
    x = x.withColumn("n", F.when(first > 0, first - 1).otherwise(shorter).cast("int"))
    rest = lambda s: F.slice(s, F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0)))
    x = x.withColumns({"p": F.slice("c", F.lit(1), F.col("n")), "c": rest("c"), "r": rest("r")})
    return x.select(
        "pair_id", F.col("n").alias("n_common"), _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
        _trained(F.col("c"), list(roles)).alias("chosen_mask"), _trained(F.col("r"), list(roles)).alias("rejected_mask"),
    )


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations (conv_id, turn, role, text).

    Chosen is a conversation as it is; in the rejected one the last answer of the assistant is
    that of another conversation. Conversations with an answer are numbered in the order of a hash
    of their id, and 2k and 2k + 1 exchange answers; of an odd number the last one loses its
    answer. A conversation without an answer is the same on both sides, so both its completions
    are empty. Every conversation makes a pair; turns whose conv_id is null are one. Ids may be
    of any type; other columns aren't looked at. Repeated rows of the last answer all change.
    """
    t = turns.select(turns["conv_id"].alias("pair_id"), "turn", "role", "text")
    said = F.struct("turn", "text")
    last = t.filter("role = 'assistant'").groupBy("pair_id").agg(F.max_by(said, said).alias("own"))
    spread = F.md5(F.coalesce(F.col("pair_id").cast("string"), F.lit("")).cast("binary"))
    order = numbered(last.select("pair_id", spread.alias("spread"), F.substring(spread, 1, 3).alias("part")), [], ["part"], ["spread", "pair_id"], "rank")
    ranked = last.join(order.select(F.col("pair_id").alias("of_id"), "rank"), F.col("pair_id").eqNullSafe(F.col("of_id"))).drop("of_id")
    other = ranked.select(F.col("rank").bitwiseXOR(F.lit(1)).alias("rank"), F.col("own").alias("other"))
    both = ranked.join(other, "rank", "left").select(F.col("pair_id").alias("of_id"), "own", "other")
    x = t.join(both, F.col("pair_id").eqNullSafe(F.col("of_id")), "left")
    swap = F.coalesce((F.col("role") == "assistant") & F.col("turn").eqNullSafe(F.col("own.turn")) & F.col("text").eqNullSafe(F.col("own.text")) & F.col("own").isNotNull(), F.lit(False))
    rejected = x.filter(~(swap & F.col("other").isNull())).select("pair_id", "turn", "role", F.when(swap, F.col("other.text")).otherwise(F.col("text")).alias("text"))
    return t, rejected


def preference_report(turns: DataFrame) -> DataFrame:
    """The formatted pairs of :func:`swapped_answers`, masks written as 'start-end,...'."""
    chosen, rejected = swapped_answers(turns)
    x = format_preferences(chosen, rejected)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return x.select(F.col("pair_id").alias("conv_id"), "n_common", "prompt", "chosen", "rejected", spans(F.col("chosen_mask")).alias("chosen_mask"), spans(F.col("rejected_mask")).alias("rejected_mask"))
