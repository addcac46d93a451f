"""Gapless numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 1024


def numbered(df: DataFrame, group: str, row: str, out: str, salts: int = SALTS) -> DataFrame:
    """Add the 0-based number of each row in its group; ``row`` must be unique.

    A group is dealt into ``salts`` units by a hash of ``row``. Rows are numbered inside their
    unit and units start where the one before ends, so no task holds a whole group: the windows
    that span a group see at most ``salts`` counts. ``df`` is read twice; pass a written table.
    """
    dealt = df.withColumn("_unit", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    along = Window.partitionBy(group).orderBy("_unit")
    starts = (
        dealt.groupBy(group, "_unit")
        .agg(F.count(F.lit(1)).alias("_unit_n"))
        .select(F.col(group).alias("_unit_group"), F.col("_unit").alias("_unit_id"), (F.sum("_unit_n").over(along) - F.col("_unit_n")).alias("_unit_start"))
    )
    place = F.row_number().over(Window.partitionBy(group, "_unit").orderBy(row)) - 1
    return (
        dealt.withColumn("_unit_place", place)
        .join(starts, F.col(group).eqNullSafe(F.col("_unit_group")) & (F.col("_unit") == F.col("_unit_id")))
        .withColumn(out, (F.col("_unit_start") + F.col("_unit_place")).cast("bigint"))
        .drop("_unit", "_unit_id", "_unit_group", "_unit_start", "_unit_place")
    )
