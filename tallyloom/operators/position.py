"""Exact 0-based positions of rows in an order, for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.values import named
from tallyloom.sources.staging import stage

PLACE_BITS = 33  # of monotonically_increasing_id: the place in the partition


def with_position(df: DataFrame, order: str | list[str | Column], out: str) -> DataFrame:
    """Add the 0-based position of each row in an order, such as by a key.

    Rows are dealt by ranges of the order, sorted and written with their place in the partition;
    a count per partition gives the start of each. One shuffle, whatever the spread of the keys,
    and a window over as many rows as there are partitions. NULL keys come first; rows with
    equal keys have consecutive positions.
    """
    order = [order] if isinstance(order, str) else order
    rows = stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftright("_id", PLACE_BITS)
    along = Window.orderBy("_part")
    starts = (
        rows.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", (F.sum("_n").over(along) - F.col("_n")).alias("_start"))
    )
    place = F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return rows.join(starts, part == F.col("_part")).select(
        *named(df.columns), (F.col("_start") + place).alias(out)
    )
