"""Written intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session: a folder that every executor can reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder


_owned: ContextVar[list[str] | None] = ContextVar("_owned", default=None)


@contextmanager
def owned_staging(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are removed at the end; read no result of them after it.

    Scopes may be nested: each removes its own. Outside of any scope staged tables stay until the
    shared folder is cleaned.
    """
    paths: list[str] = []
    token = _owned.set(paths)
    try:
        yield
    finally:
        _owned.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            place = hadoop(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Use it before a table is read several times. It cuts the lineage, so lost executors cost a
    re-read and never a recomputation; later reads are column-pruned; and the optimizer knows
    the bytes on disk, so it broadcasts the table in a join only if it is small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    if (owned := _owned.get()) is not None:
        owned.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
