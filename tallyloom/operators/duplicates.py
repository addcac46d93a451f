"""Rows whose key occurs more than once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import DUPLICATE_KEY
from tallyloom.functions.values import named
from tallyloom.sources.staging import stage


def duplicate_columns(df: DataFrame) -> list[str]:
    """The key columns that the table has."""
    return [c for c in DUPLICATE_KEY if c in df.columns]


def repeated_keys(df: DataFrame, keys: Sequence[str], mark: Column | None = None) -> DataFrame:
    """The keys that occur more than once, with their counts; NULL equals NULL.

    Nearly all keys of a ledger occur once, so they are first counted by a 64-bit hash: what is
    shuffled is a hash and a count, combined before. Only rows whose hash occurs more than once go
    on to the exact count by the keys themselves, which a hash in common does not join. The list
    of hashes is written: the optimizer broadcasts it if it is small. ``df`` is read twice, so pass a
    written table. ``mark`` may be any other expression that is equal where all keys are.
    """
    mark = F.xxhash64(*named(keys)) if mark is None else mark
    marked = df.select(*named(keys), mark.alias("_mark"))
    counted = marked.groupBy("_mark").agg(F.count(F.lit(1)).alias("_n"))
    several = stage(counted.where(F.col("_n") > 1).select(F.col("_mark").alias("_several")))
    candidates = marked.join(several, F.col("_mark").eqNullSafe(F.col("_several")), "left_semi")
    return candidates.groupBy(*named(keys)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def flag_duplicates(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Add a boolean that marks every member of a repeated key.

    A window over the key would send all rows of a key to one task. Here keys are counted with
    map-side combining and only repeated ones are written, one row per key; the table joins them
    back. The optimizer broadcasts that list if its bytes on disk allow; beyond that it is a
    shuffle join, in which adaptive execution splits the rows of a very frequent key.
    """
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    repeated = stage(repeated_keys(df, keys).withColumnsRenamed(names))
    same = same_keys(names)
    listed = repeated.select(*names.values(), F.lit(True).alias("_repeated"))
    return df.join(listed, same, "left").select(*named(df.columns), F.col("_repeated").isNotNull().alias(out))


def same_keys(names: dict[str, str]) -> Column:
    """Whether each key column equals the one that it is renamed to; NULL equals NULL."""
    return reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(n)) for c, n in zip(named(names), names.values())])
