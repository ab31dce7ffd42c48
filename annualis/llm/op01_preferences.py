"""Preference pairs: the turns that a chosen and a rejected conversation share, rendered once
as the prompt, and what follows in each as a completion with its loss mask.

All of it is array and string functions of one row per pair; a conversation is one value of
the result, so its turns stand in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annualis.operators.prefix import prefix_sums

#: How a turn is rendered; only the text and the end mark of a trained role count in the loss.
OPEN, AFTER_ROLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLES = ("assistant",)


def conversations_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                     text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as an array of (role, text).

    Rows without a conversation id are left out; null roles count as "user", null texts as
    empty; rows that repeat a turn entirely count once, other rows of equal turn number are
    ordered by role and text; null turn numbers come first."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("user")).alias("role"),
            F.coalesce(text_col, F.lit("")).alias("text")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(AFTER_ROLE), turn["text"], F.lit(END))


def _rendered_all(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column, roles: tuple[str, ...]) -> Column:
    """Trained character spans [start, end) of the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        body = acc["at"] + F.length(F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE)))
        end = acc["at"] + F.length(rendered(t))
        span = F.array(F.struct(body.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"].isin(*roles), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_preferences(pairs: DataFrame, pair_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected",
                       roles: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """(pair_col, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask).

    chosen_col and rejected_col are arrays of (role, text).  prompt is the rendering of the
    longest common prefix of turns (equal role and text); chosen and rejected are the
    renderings of the rest; the masks are the character spans of a completion that are
    trained on.  Equal conversations have two empty completions; one that is a prefix of the
    other has an empty completion; a null side counts as no turns; extra columns are ignored."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    p = pairs.select(F.col(pair_col).alias("pair"), F.coalesce(F.col(chosen_col), none).alias("a"), F.coalesce(F.col(rejected_col), none).alias("b"))
    differs = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(differs, False)
    p = p.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("a")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    p = p.select("pair", "n", F.slice("a", F.lit(1), F.col("n")).alias("head"), rest("a").alias("a"), rest("b").alias("b"))
    return p.select(
        F.col("pair").alias(pair_col), F.col("n").alias("prompt_turns"), _rendered_all(F.col("head")).alias("prompt"),
        _rendered_all(F.col("a")).alias("chosen"), _rendered_all(F.col("b")).alias("rejected"),
        _mask(F.col("a"), roles).alias("chosen_mask"), _mask(F.col("b"), roles).alias("rejected_mask"))


def answer_swaps(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): preference pairs from plain conversations.

    chosen is a conversation up to its last assistant turn; what follows that turn is no
    completion.  One of its assistant turns, by a hash of the id, is where rejected departs: rejected
    has the turns before it and then those of the next conversation in id order that has an answer
    (after the last one the first), from that one's own point of departure on.  So pairs share
    prompts of all lengths, and completions of several and of different numbers of turns.
    Conversations without an answer give no pair, and a lone one has no other."""
    c = conversations_of(turns.withColumn("conv_id", F.col("conv_id").cast("long")))
    c = c.where(F.exists("turns", lambda t: t["role"] == F.lit("assistant")))
    at = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == F.lit("assistant"))
    pick = F.conv(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 4), 16, 10).cast("int") % F.size("at") + 1
    c = c.withColumn("at", at).select("conv_id", F.slice("turns", F.lit(1), F.element_at("at", -1)).alias("turns"), F.element_at("at", pick).alias("d"))
    # the next id: numbered by running sums over range partitions of the bare ids
    ids = prefix_sums(c.select("conv_id", F.lit(1).cast("long").alias("one")), ["conv_id"], {"place": "one"}).select("conv_id", "place")
    n = ids.select(F.count(F.lit(1))).scalar()
    after = ids.where(n > 1).select("conv_id", ((F.col("place") + 1) % n).alias("place"))
    donor = after.join(ids.select("place", F.col("conv_id").alias("donor")), "place").select("conv_id", "donor")
    tail = c.select(F.col("conv_id").alias("donor"), F.slice("turns", F.col("d"), F.size("turns") - F.col("d") + 1).alias("tail"))
    return c.join(donor, "conv_id").join(tail, "donor").select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.col("d") - 1), "tail").alias("rejected"))
