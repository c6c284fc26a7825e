"""The key-value log as a table: puts, deletes, watching for changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, revision bigint, op string, value string"


def entries(spark: SparkSession, rows: list[tuple[str, int, str, str | None]]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def put(spark: SparkSession, path: str, rows: list[tuple[str, int, str | None]]) -> None:
    """Append PUTs (or DELs, where the value is None) to the log."""
    entries(spark, [(k, r, "DEL" if v is None else "PUT", v) for k, r, v in rows]).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def watch(spark: SparkSession, path: str) -> DataFrame:
    """New entries as a stream; only PUTs pass."""
    return spark.readStream.schema(SCHEMA).parquet(path).where("op = 'PUT'")


def matching(log: DataFrame, pattern: str) -> DataFrame:
    """Keys that a subject pattern fits: `*` is one token."""
    expression = "^" + r"\.".join("[^.]+" if t == "*" else t.replace("$", r"\$") for t in pattern.split(".")) + "$"
    return log.where(F.col("key").rlike(expression))
