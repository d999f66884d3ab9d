"""Preference formatting of chosen and rejected conversations, in DataFrame
functions only.

Both sides of a pair are lined up by turn; the longest run of equal leading
turns is rendered once as the prompt, what follows on each side as that side's
completion. A completion's mask lists the character ranges that count for the
loss: content and end mark of the assistant's turns.

Defined results: null text is empty, a null role is ``user``. Rows that repeat
a (pair, side, turn) count once, the smallest (role, text). A null turn comes
first. Rows with a null pair or another side are left out. A side that has no
turn gives an empty completion, equal sides two empty ones; ``usable`` says
whether both sides have something to learn. A pair is one row, so it holds its
two conversations and nothing else; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of a rendered turn.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def _completion(turns: Column) -> Column:
    """struct(text, mask) of an array of (role, text) turns."""
    empty = F.struct(
        F.lit("").alias("text"),
        F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def add(done: Column, t: Column) -> Column:
        header = F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE))
        start = F.length(done["text"]) + F.length(header)
        end = start + F.length(t["text"]) + F.lit(len(END))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            F.concat(done["text"], rendered(t["role"], t["text"])).alias("text"),
            F.when(t["role"] == TRAINED_ROLE, F.concat(done["mask"], span))
            .otherwise(done["mask"]).alias("mask"))
    return F.aggregate(turns, empty, add)


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row a pair of ``turns`` (pair_id, side 'chosen' or 'rejected', turn, role,
    text): pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected,
    rejected_mask, usable."""
    one = F.struct(F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
                   F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lined = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")) \
        .select("pair_id", "turn", "side", one.alias("t")) \
        .groupBy("pair_id", "turn").agg(
            F.min(F.when(F.col("side") == "chosen", F.col("t"))).alias("c"),
            F.min(F.when(F.col("side") == "rejected", F.col("t"))).alias("r"))
    pairs = lined.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.coalesce(F.col("turn").cast("long"), F.lit(-2**63)).alias("turn"), "c", "r")))
        .alias("ts"))
    first_other = F.array_position(
        F.transform("ts", lambda t: ~t["c"].eqNullSafe(t["r"])), True)
    pairs = pairs.withColumn("k", F.when(first_other > 0, first_other - 1)
                             .otherwise(F.size("ts")).cast("int"))

    def side(name: str) -> Column:
        rest = F.slice("ts", F.col("k") + 1, F.size("ts"))
        return _completion(F.transform(F.filter(rest, lambda t: t[name].isNotNull()),
                                       lambda t: t[name]))
    prompt = F.array_join(F.transform(
        F.slice("ts", F.lit(1), F.col("k")),
        lambda t: rendered(t["c"]["role"], t["c"]["text"])), "")
    return pairs.select("pair_id", F.col("k").alias("prompt_turns"), prompt.alias("prompt"),
                        side("c").alias("c"), side("r").alias("r")) \
        .select("pair_id", "prompt_turns", "prompt",
                F.col("c.text").alias("chosen"), F.col("c.mask").alias("chosen_mask"),
                F.col("r.text").alias("rejected"), F.col("r.mask").alias("rejected_mask"),
                ((F.size("c.mask") > 0) & (F.size("r.mask") > 0)).alias("usable"))
