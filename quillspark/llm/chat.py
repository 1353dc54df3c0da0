"""Preference formatting of chosen and rejected conversations, by DataFrame functions alone.

Two conversations share their longest common prefix of equal turns (role and text). It is rendered once as prompt;
what follows in each is a completion. A completion's mask is the list of its spans (code points, end exclusive) that
count for the loss: the texts of assistant turns with their end mark. A turn is rendered as
`<|role|>` line end, text, `<|end|>` line end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running

END = "<|end|>\n"
TURN = "struct<turn:bigint,role:string,text:string>"


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """"start:end" of each assistant turn, comma-joined."""
    size = lambda t: (F.length(_head(t)) + F.length(t["text"]) + F.lit(len(END))).cast("long")

    def spans(ends: Column) -> Column:
        at = lambda t, i: F.concat((ends[i] + F.length(_head(t))).cast("string"), F.lit(":"), (ends[i] + size(t)).cast("string"))
        return F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", at(t, i)))

    return F.array_join(F.array_compact(let(running(F.transform(turns, size), F.lit(0).cast("long")), spans)), ",")


def pair_neighbours(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id): conversations 2k and 2k + 1, where both are there; the even one is chosen."""
    ids = turns.select(F.col("conv_id").cast("long").alias("c")).filter("c is not null")
    pairs = ids.groupBy(F.shiftright("c", 1).alias("pair_id")).agg(F.min("c").alias("chosen_id"), F.max("c").alias("rejected_id"))
    return pairs.filter("chosen_id <> rejected_id")


def preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each pair: pair_id, n_prompt, prompt, chosen, chosen_mask, rejected, rejected_mask.

    turns: conv_id, turn, role, text, ordered by turn (then role, text); pairs: pair_id, chosen_id, rejected_id.
    A null role is "unknown", a null text empty; a null turn comes first. Turns of a null conversation belong to no
    pair. A pair that names a conversation without turns is left out, as there is nothing to compare. Repeated turns
    are turns each; pairs of one id with other conversations are rows each, repeated pairs one. Equal conversations have empty completions. A conversation is
    one row of the result, so its turns meet in one task; a pair that shares its conversation with many others does
    not make that larger.
    """
    turn = F.struct(F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), turn.alias("t"))
    sides = pairs.select("pair_id", F.col("chosen_id").cast("long").alias("a"), F.col("rejected_id").cast("long").alias("b")).distinct()
    sides = sides.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("conv")), F.struct(F.lit(1).alias("side"), F.col("b").alias("conv"))))).select("pair_id", "a", "b", "col.*")
    both = rows.join(sides, "conv").groupBy("pair_id", "a", "b").agg(
        *(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("t")))).alias(c) for k, c in enumerate(("c", "r")))
    )
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    both = both.filter("size(c) > 0 and size(r) > 0").withColumn("differ", F.array_position(same, False)).withColumn("n", F.when(F.col("differ") == 0, F.size("c")).otherwise(F.col("differ") - 1).cast("int"))
    both = both.select("pair_id", F.col("n").alias("n_prompt"), F.expr("slice(c, 1, n)").alias("p"), F.expr("slice(c, n + 1, size(c))").alias("c"), F.expr("slice(r, n + 1, size(r))").alias("r"))
    return both.select("pair_id", "n_prompt", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _render(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))
