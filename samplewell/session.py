"""Sessions as this library wants them: UTC, adaptive execution, ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", shuffle_partitions)
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
