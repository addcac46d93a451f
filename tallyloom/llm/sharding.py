"""Documents into shards by vector bin packing."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.ranks import numbered
from tallyloom.sources.staging import stage

BUNDLES = 4096
WORD = r"[^\x20\x09-\x0D]+"
MEASURES = ("_bytes", "_tokens", "_rows")


def place(loads: np.ndarray, shards: int) -> list[int]:
    """The shard of each load vector: where its dot product with the residual capacity is highest.

    Each measure is scaled to a total of 1 and every shard starts with an equal share of each.
    The largest loads go first.
    """
    total = loads.sum(axis=0)
    loads = loads / np.where(total > 0, total, 1)
    room = np.full((shards, loads.shape[1]), 1 / shards)
    out = [0] * len(loads)
    for i in np.argsort(-loads.max(axis=1), kind="stable"):
        out[i] = shard = int(np.argmax(room @ loads[i]))
        room[shard] -= loads[i]
    return out


def assign_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, bundles: int = BUNDLES
) -> DataFrame:
    """``key, size, text_crc32, shard, slot`` with bytes, tokens and rows balanced jointly.

    Groups of equal texts stay together. A group with more than one part in ``bundles`` of any
    measure, of which there are at most ``bundles`` per measure, is placed by itself; the others
    are bundled by a hash of the text, ``bundles`` of them. All these load vectors are placed on the
    driver (see ``place``). A group with more than a quarter of a shard in any measure, of which
    there are at most ``4 * shards`` per measure, is dealt over the bundles row by row, as no shard
    could hold it and stay even. Slots are gapless in each shard.

    Size is the UTF-8 bytes plus 1, a null text counts as empty. Tokens are the words, runs of
    characters other than blanks. Repeated rows and null keys are rows like any other.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = stage(
        docs.select(
            F.col(key).alias("_key"),
            (F.octet_length(value) + 1).cast("bigint").alias("_bytes"),
            F.regexp_count(value, F.lit(WORD)).cast("bigint").alias("_tokens"),
            F.lit(1).cast("bigint").alias("_rows"),
            F.crc32(value.cast("binary")).alias("_crc"),
            F.xxhash64(value).alias("_group"),
        ).withColumn("_row", F.monotonically_increasing_id())
    )
    total = rows.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]).first()
    sums = [F.sum(m).alias(m) for m in MEASURES]
    over = lambda parts: reduce(or_, (F.col(m) * parts > total[m] for m in MEASURES))
    single = rows.groupBy("_group").agg(*sums).where(over(bundles)).select(F.col("_group").alias("_single"), over(4 * shards).alias("_split"))
    bundle = F.when(F.col("_single").isNotNull() & ~F.col("_split"), F.col("_group")).otherwise(
        F.pmod(F.xxhash64(F.when(F.col("_split"), F.xxhash64("_row")).otherwise(F.col("_group"))), F.lit(bundles))
    )
    rows = rows.join(F.broadcast(single), F.col("_group") == F.col("_single"), "left").withColumn("_bundle", bundle)
    loads = rows.groupBy("_bundle").agg(*sums).orderBy("_bundle").collect()  # at most four times `bundles`
    found = place(np.array([[r[m] for m in MEASURES] for r in loads], dtype=float).reshape(-1, 3), shards)
    plan = docs.sparkSession.createDataFrame(
        [(r["_bundle"], s) for r, s in zip(loads, found)], "_bundle bigint, _shard int"
    )
    placed = rows.join(F.broadcast(plan), "_bundle").drop("_single", "_split")
    return numbered(placed, "_shard", "_row", "_slot").select(
        F.col("_key").alias(key),
        F.col("_bytes").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
    )
