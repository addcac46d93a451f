"""Session settings the jobs are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    Partition counts and memory are left to the cluster; pass them as ``conf`` with ``_`` for
    ``.``, e.g. ``spark_sql_shuffle_partitions="8"`` in tests.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()
