"""Preference formatting: the common turn prefix of a chosen and a rejected
conversation as prompt, and the two masked completions.  DataFrame
expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import carry


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("\n<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def loss_spans(turns: Column, learn: str) -> Column:
    """start:end of what each ``learn`` turn's writer said, end mark included,
    in code points of the rendered completion."""
    def step(at, t):
        size = F.length(rendered(t))
        head = F.length(F.coalesce(t["role"], F.lit(""))) + 5
        return at + size, F.when(t["role"] == learn, F.concat_ws(":", at + head, at + size - 1))

    return F.array_join(carry(turns, F.lit(0), step, "string"), ",")  # a masked turn's null is left out


def format_preferences(turns: DataFrame, pairs: DataFrame, learn: str = "assistant", conv_col: str = "conv_id",
                       turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair (pair_id, chosen_id, rejected_id): n_prompt_turns,
    prompt, chosen, rejected, chosen_loss, rejected_loss, status.

    The longest common prefix of the two conversations' turns (equal role and
    text, in turn order) is rendered once as ``prompt``; what follows is each
    side's completion, and the loss spans cover the ``learn`` turns in it;
    everything else, the prompt included, is masked.  ``status``: ``pair``;
    ``identical`` (no completion on either side); ``chosen_prefix`` or
    ``rejected_prefix`` (that side has no completion); ``unpaired`` (a side
    has no turns).

    Turns sort by number, role, text; nulls come first and render as empty;
    repeated turns are turns.  Rows without a conversation id belong to no
    conversation.  Null pair or conversation ids match nothing and give
    ``unpaired``.  Extra columns are ignored; empty tables give empty results.
    A pair's turns meet in one row, as its rendering is one row.
    """
    t = turns.select(F.col(conv_col).alias("conv"), F.struct(
        F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).alias("t"))
    convs = t.where("conv is not null").groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    p = pairs.select("pair_id", "chosen_id", "rejected_id")
    p = p.join(convs.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id", "left")
    p = p.join(convs.select(F.col("conv").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id", "left")
    return finish(p, learn)


def format_neighbours(turns: DataFrame, learn: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``format_preferences`` for the pairs (2k, 2k + 1) of conversation ids,
    the even one chosen; one shuffle brings both sides of a pair together."""
    t = turns.where(F.col(conv_col).isNotNull()).select(
        F.shiftright(F.col(conv_col).cast("long"), 1).alias("pair_id"), F.struct(
            F.col(conv_col).cast("long").bitwiseAND(F.lit(1).cast("long")).alias("side"), F.col(turn_col).alias("turn"),
            F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).alias("t"))
    g = t.groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    g = g.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"),
                 F.filter("turns", lambda x: x["side"] == 0).alias("a"), F.filter("turns", lambda x: x["side"] == 1).alias("b"))
    return finish(g, learn)


def finish(p: DataFrame, learn: str) -> DataFrame:
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    p = p.select("pair_id", "chosen_id", "rejected_id", *[F.coalesce(F.transform(F.col(c), lambda x: F.struct(
        x["turn"].cast("long").alias("turn"), x["role"].alias("role"), x["text"].alias("text"))), none).alias(c) for c in "ab"])
    same = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, F.lit(False))
    p = p.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("long"))
    n = F.col("n").cast("int")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    p = p.select("pair_id", "chosen_id", "rejected_id", "n", F.slice("a", 1, n).alias("shared"), rest("a").alias("ra"), rest("b").alias("rb"),
                 F.size("a").alias("na"), F.size("b").alias("nb"))
    status = (F.when((F.col("na") == 0) | (F.col("nb") == 0), "unpaired")
              .when((F.size("ra") == 0) & (F.size("rb") == 0), "identical")
              .when(F.size("ra") == 0, "chosen_prefix").when(F.size("rb") == 0, "rejected_prefix").otherwise("pair"))
    return p.select("pair_id", "chosen_id", "rejected_id", F.col("n").alias("n_prompt_turns"), render(F.col("shared")).alias("prompt"),
                    render(F.col("ra")).alias("chosen"), render(F.col("rb")).alias("rejected"),
                    loss_spans(F.col("ra"), learn).alias("chosen_loss"), loss_spans(F.col("rb"), learn).alias("rejected_loss"),
                    status.alias("status"))
