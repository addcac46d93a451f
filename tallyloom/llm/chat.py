"""Conversations logged as growing snapshots: keep the maximal ones and render them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.staging import stage

PART = 512


def turn_prefixes(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``_conv, _pos, _role, _text, _a, _b``: every turn, its place from 1, its prefix hash.

    The hash of a prefix is the XOR of two 64-bit hashes of each turn with its place, so it rolls
    from turn to turn and needs no order of evaluation. Turns are numbered inside blocks of
    ``PART`` turn numbers; blocks are then put in a row, so a long conversation is never in one
    task. Turns without a number come first; equal numbers are ordered by content.
    """
    block = F.coalesce(F.floor(F.col(turn) / PART), F.lit(-(2**40)))
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
        block.alias("_block"),
    ).withColumn("_h", F.xxhash64("_role", "_text"))
    before = Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_conv", "_block").orderBy("_turn", "_h").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_k"))
    names = [F.col("_conv").alias("_c"), F.col("_block").alias("_k")]
    counts = rows.groupBy("_conv", "_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = (
        rows.withColumn("_place", F.row_number().over(inside))
        .join(starts, same)
        .withColumn("_pos", F.col("_start") + F.col("_place"))
        .withColumns({"_x": F.xxhash64("_h", "_pos"), "_y": F.xxhash64("_pos", "_text", "_role")})
        .withColumns({"_a": F.expr("bit_xor(_x)").over(inside), "_b": F.expr("bit_xor(_y)").over(inside)})
    )
    placed = stage(placed.select("_conv", "_block", "_pos", "_role", "_text", "_x", "_y", "_a", "_b"))
    sums = placed.groupBy("_conv", "_block").agg(F.expr("bit_xor(_x)").alias("_sx"), F.expr("bit_xor(_y)").alias("_sy"))
    zero = F.lit(0).cast("bigint")
    sums = sums.select(
        *names,
        F.coalesce(F.expr("bit_xor(_sx)").over(before), zero).alias("_px"),
        F.coalesce(F.expr("bit_xor(_sy)").over(before), zero).alias("_py"),
    )
    return placed.join(sums, same).select(
        "_conv", "_pos", "_role", "_text",
        F.col("_a").bitwiseXOR(F.col("_px")).alias("_a"), F.col("_b").bitwiseXOR(F.col("_py")).alias("_b"),
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """``_c, n_turns, copies``: conversations that no longer one begins with.

    Prefixes are counted by place and hash before they are compared, so a first turn that a third
    of all conversations share is one row. Where more conversations pass through a prefix than
    end there, those that end there are left out by an anti-join. Equal conversations are one,
    named by the smallest id.
    """
    keys = ["_pos", "_a", "_b"]
    ends = prefixes.groupBy("_conv").agg(F.max(F.struct(*keys)).alias("e")).select("_conv", "e.*")
    ends = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min("_conv").alias("_c"))
    passing = prefixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_passing"))
    longer = passing.join(ends.select(*keys, "copies"), keys).where("_passing > copies").select(*keys)
    return ends.join(longer, keys, "left_anti").select("_c", F.col("_pos").alias("n_turns"), "copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, part, n_turns, copies, text``: the maximal conversations as chat text.

    A conversation is one row for every ``PART`` turns, so that no row or task grows with a
    conversation; shorter ones have the one part 0. Null roles and texts are empty. Rows without
    a conversation id are one conversation. Repeated rows are turns of their own.
    """
    prefixes = stage(turn_prefixes(turns, conv, turn, role, text))
    kept = maximal_conversations(prefixes.drop("_role", "_text"))
    item = F.struct("_pos", rendered(F.col("_role"), F.col("_text")).alias("t"))
    part = F.floor((F.col("_pos") - 1) / PART)
    return (
        prefixes.join(kept, F.col("_conv").eqNullSafe(F.col("_c")))
        .groupBy(F.col("_conv").alias(conv), part.alias("part"), "n_turns", "copies")
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .select(conv, "part", "n_turns", "copies", F.concat_ws("", F.transform("_items", lambda x: x["t"])).alias("text"))
    )
