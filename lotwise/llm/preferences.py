"""Preference formatting: one prompt and two masked completions for chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what follows on
each side is its completion. In completions the text and end mark of assistant turns
are trained, everything else is masked, as is the whole prompt.

Everything stays a row a turn, so a conversation of any length is spread like others:
turns of both sides meet by their number, the first number at which the sides differ
ends the prompt, and rows are rendered in place. Texts are compared by digests.

Defined cases: the turn number is the turn's place, a null number comes before all
others; rows of one conversation with the same number form one turn and are equal
when the same roles and texts occur equally often; a null role is ``unknown`` and a
null text is empty; a pair that lacks a side gives no rows; sides that are equal
throughout give a prompt and no completions; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
FIRST = -(1 << 62)  # place of a null turn number


def _turns(side: DataFrame) -> DataFrame:
    return side.select(
        F.col("pair_id").cast("long").alias("pair_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter("pair_id IS NOT NULL")


def _digests(turns: DataFrame, name: str) -> DataFrame:
    """What a turn of one side is, as a count and two sums over its rows."""
    value = F.xxhash64("role", "text")
    return turns.groupBy("pair_id", "turn").agg(
        F.struct(
            F.count("*").alias("n"),
            F.bit_xor(value).alias("xor"),
            F.sum(F.xxhash64("text", "role").cast("decimal(20,0)")).alias("sum"),
        ).alias(name)
    )


def split_at(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """For every pair with both sides: the first turn number at which they differ, null if none."""
    both = _digests(chosen, "left").join(_digests(rejected, "right"), ["pair_id", "turn"], "full")
    return (
        both.groupBy("pair_id")
        .agg(
            F.min(F.when(~F.col("left").eqNullSafe(F.col("right")), F.col("turn"))).alias("split"),
            F.count("left").alias("n_left"),
            F.count("right").alias("n_right"),
        )
        .filter("n_left > 0 AND n_right > 0")
        .select("pair_id", "split")
    )


def _rendered(rows: DataFrame) -> DataFrame:
    head = F.concat(F.lit(OPEN), "role", F.lit("\n"))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED)
    whole = F.concat(head, "text", F.lit(CLOSE))
    return rows.select(
        "pair_id",
        "part",
        F.when(F.col("turn") != FIRST, F.col("turn")).alias("turn"),
        "role",
        whole.alias("rendered"),
        F.when(trained, F.length(head)).cast("long").alias("trained_from"),
        F.when(trained, F.length(whole)).cast("long").alias("trained_to"),
    )


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Turns of prompts and completions: pair_id, part, turn, role, rendered, trained_from, trained_to.

    Both inputs have pair_id, turn, role and text. ``part`` is prompt, chosen or
    rejected; in order of turn the rendered texts of a part give the whole. Offsets
    count characters of the rendered turn, null where nothing is trained.
    """
    chosen, rejected = _turns(chosen), _turns(rejected)
    splits = written(split_at(chosen, rejected), "preference-splits")
    before = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    left = chosen.join(splits, "pair_id").withColumn("part", F.when(before, "prompt").otherwise("chosen"))
    right = rejected.join(splits, "pair_id").filter(~before).withColumn("part", F.lit("rejected"))
    return _rendered(left.unionByName(right))


def _with_next_reply(last: DataFrame) -> DataFrame:
    """Conversations with a reply, and as ``other`` the reply of the next one by id; after the last comes the first.

    Sorted by ranges of ids, so rows are numbered from the sizes of the ranges.
    """
    ordered = last.repartitionByRange("pair_id").sortWithinPartitions("pair_id")
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "replies")
    # One row for each range: as many as there were tasks.
    sizes = ordered.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range")) - F.col("n")
    numbered = ordered.withColumn("range", F.shiftright("at", 33)).join(sizes.select("range", before.alias("before")), "range")
    place = F.col("at").bitwiseAND((1 << 33) - 1)
    numbered = numbered.select("pair_id", "last", "reply", (F.col("before") + place).alias("number"))
    whole = F.lit(max(ordered.count(), 1)).cast("long")
    donors = numbered.select(F.pmod(F.col("number") - 1, whole).alias("number"), F.col("reply").alias("other"))
    return numbered.join(donors, "number").select("pair_id", "last", "other")


def replaced_reply(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations (conv_id, turn, role, text).

    Chosen is a whole conversation; in rejected its last assistant turn has the text of
    the last assistant turn of the next conversation by id that has one. Conversations
    without an assistant turn have no sides.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text")
    turns = turns.filter("pair_id IS NOT NULL")
    replies = turns.filter((F.col("role") == TRAINED) & F.col("turn").isNotNull())
    last = replies.groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    last = last.select("pair_id", F.col("last.turn").alias("last"), F.col("last.text").alias("reply"))
    known = written(_with_next_reply(last), "replies")
    chosen = turns.join(known, "pair_id")
    swapped = (F.col("turn") == F.col("last")) & (F.col("role") == TRAINED)
    rejected = chosen.withColumn("text", F.when(swapped, F.col("other")).otherwise(F.col("text")))
    return chosen.drop("last", "other"), rejected.drop("last", "other")
