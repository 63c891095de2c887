"""Chat formatting: cumulative snapshots collapse to maximal conversations, then render.

A turn's hash is salted with its number, role and text; a prefix's hash is the
sum of its turns' hashes (two independent 64-bit ones, kept as exact decimals)
with its number of turns, so it rolls by addition and can be summed in blocks: a
conversation of any length is never gathered in one task. A conversation whose
hash is a proper prefix hash of another's is a snapshot of it and goes by an
anti-join; of equal conversations the smallest conv_id stays. What stays is
rendered block by block, ``block`` turn numbers to a segment. Markup that stands
in a text gets a backslash after its first character (one more if it has some), so
a text can't open or close a turn and can be read back; a role is one line.

Defined results: rows without a conv_id or turn belong to no conversation; null
roles and texts are empty; a repeated row counts once; two rows of one turn that
differ are both kept, by role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The public chat markup, and what looks like it in a text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
MARKUP = r"<(\\*\|im_(?:start|end)\|>)"


def plain(text: Column) -> Column:
    """A text that holds no markup."""
    return F.regexp_replace(text, MARKUP, r"<\\$1")


def _turns(conversations: DataFrame, block: int) -> DataFrame:
    return (
        conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL")
        .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
        .withColumn("block", F.floor(F.col("turn") / block).cast("long"))
    )


def _hashed(turns: DataFrame) -> DataFrame:
    number = "decimal(20,0)"
    return turns.select(
        "conv_id", "block", "turn", F.xxhash64("turn", "role", "text").cast(number).alias("h"), F.xxhash64(F.lit("second"), "text", "turn", "role").cast(number).alias("g")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, total_turns) of the conversations that are no prefix of a longer one."""
    hashed = _hashed(turns)
    blocks = hashed.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.sum("g").alias("g"))
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("g").alias("g"))
    distinct = whole.groupBy("n", "h", "g").agg(F.min("conv_id").alias("conv_id"))
    # what stands before each block, from one row a block
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("conv_id")
    zero = F.lit(0)
    bases = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(before), zero).alias("n0"), F.coalesce(F.sum("h").over(before), zero).alias("h0"), F.coalesce(F.sum("g").over(before), zero).alias("g0"), F.sum("n").over(all_of).alias("total"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "h", "g").rowsBetween(Window.unboundedPreceding, 0)
    rolling = hashed.select("conv_id", "block", F.count("*").over(inside).alias("n1"), F.sum("h").over(inside).alias("h1"), F.sum("g").over(inside).alias("g1"))
    sum_type = "decimal(38,0)"
    prefixes = (
        rolling.join(bases, ["conv_id", "block"])
        .select((F.col("n0") + F.col("n1")).alias("p_n"), (F.col("h0") + F.col("h1")).cast(sum_type).alias("p_h"), (F.col("g0") + F.col("g1")).cast(sum_type).alias("p_g"), "total")
        .where("p_n < total")
        .select("p_n", "p_h", "p_g")
        .distinct()
    )
    same = (F.col("n") == F.col("p_n")) & (F.col("h").cast(sum_type) == F.col("p_h")) & (F.col("g").cast(sum_type) == F.col("p_g"))
    return distinct.join(prefixes, same, "left_anti").select("conv_id", F.col("n").alias("total_turns"))


def render(conversations: DataFrame, block: int = 256) -> DataFrame:
    """(conv_id, segment, n_turns, total_turns, text) of the maximal conversations."""
    turns = _turns(conversations, block)
    kept = maximal(turns)
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    one = lambda t: F.concat(F.lit(OPEN), plain(F.translate(t["role"], "\r\n", "  ")), F.lit("\n"), plain(t["text"]), F.lit(CLOSE + "\n"))
    return (
        turns.join(kept, "conv_id")
        .groupBy("conv_id", "block", "total_turns")
        .agg(F.count("*").alias("n_turns"), ordered.alias("turns"))
        .select("conv_id", F.col("block").alias("segment"), "n_turns", "total_turns", F.array_join(F.transform("turns", one), "").alias("text"))
    )
