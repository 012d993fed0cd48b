"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions. DataFrame functions only.

The prompt is the longest common prefix of turns (same role and text), rendered once. What follows in each conversation is its completion;
its mask has 1 for each part that is trained on (assistant turns) and 0 for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = ("<|", "|>\n", "\n<|end|>\n")


def render(turn: Column) -> Column:
    return F.concat(F.lit(TURN[0]), F.coalesce(turn["role"], F.lit("")), F.lit(TURN[1]), F.coalesce(turn["text"], F.lit("")), F.lit(TURN[2]))


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv and turns, its turns in order. A conversation is one training example and stays in one row.

    Ties of turn are ordered by role and text, repeated turns stay, null turns come first; rows without conversation are no conversation's.
    """
    fields = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = turns.where(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_list(fields)).alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def with_corrupted(rows: DataFrame) -> DataFrame:
    """Pairs from conversations alone: chosen is the conversation, rejected is the same with its last assistant turn's words in reversed order.

    The usual way to get negatives where none were collected: the corrupted answer has the same words and length, so only
    order tells them apart. Conversations without an assistant turn of at least two different words give no pair.
    """
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    rows = rows.withColumn("at", last).where("at is not null")
    rows = rows.withColumn("good", F.coalesce(F.get("turns", F.col("at"))["text"], F.lit("")))
    words = F.split("good", " ", -1)
    rows = rows.withColumn("bad", F.array_join(F.reverse(words), " "))
    rejected = F.transform("turns", lambda t, i: F.when(i == F.col("at"), F.struct(t["role"].alias("role"), F.col("bad").alias("text"))).otherwise(t))
    return rows.where("bad <> good").select(F.col("conv").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def format_pairs(pairs: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """pair_id, n_common (turns in the prompt), prompt, and for each side completion, mask and spans.

    pairs has pair_id, chosen and rejected, arrays of (role, text). mask has 0 or 1 for each completion turn; spans the
    [start, end) code points of the completion that are trained on, by turn. A null side counts as no turns; null text as
    an empty one, and equals another null only. Conversations that are equal, or of which one begins the other, leave an empty
    completion. Repeated pairs stay; other columns are left out, and an empty table gives no rows.
    """
    chosen, rejected = (F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")) for c in ("chosen", "rejected"))
    rows = pairs.select("pair_id", chosen.alias("chosen"), rejected.alias("rejected"))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.zip_with(F.slice("chosen", F.lit(1), shorter), F.slice("rejected", F.lit(1), shorter), lambda a, b: ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])))
    first = F.array_position(differs, True)
    rows = rows.withColumn("n_common", F.when(first > 0, first - 1).otherwise(shorter).cast("long"))
    out = [F.col("pair_id"), F.col("n_common"), F.array_join(F.transform(F.slice("chosen", F.lit(1), F.col("n_common").cast("int")), render), "").alias("prompt")]
    for side in ("chosen", "rejected"):
        rest = F.slice(side, (F.col("n_common") + 1).cast("int"), F.size(side))
        rows = rows.withColumn(f"{side}_parts", F.transform(rest, lambda t: F.struct(render(t).alias("text"), F.coalesce((t["role"] == trained_role).cast("int"), F.lit(0)).alias("on"), F.length(F.coalesce(t["role"], F.lit(""))).alias("skip"))))
        ends = F.aggregate(
            F.col(f"{side}_parts"),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
            lambda s, p: F.struct(
                (s["at"] + F.length(p["text"])).alias("at"),
                F.when(p["on"] == 1, F.concat(s["spans"], F.array(F.struct((s["at"] + p["skip"] + len(TURN[0]) + len(TURN[1])).alias("start"), (s["at"] + F.length(p["text"])).alias("end"))))).otherwise(s["spans"]).alias("spans"),
            ),
            lambda s: s["spans"],
        )
        out += [F.array_join(F.transform(f"{side}_parts", lambda p: p["text"]), "").alias(f"{side}_completion"), F.transform(f"{side}_parts", lambda p: p["on"]).alias(f"{side}_mask"), ends.alias(f"{side}_spans")]
    return rows.select(*out)
