"""Signals (t, v, nth) from files: archived Parquet, exported CSV, recorder text. nth orders samples of the same time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewell.operators import series


def from_parquet(spark: SparkSession, path: str, column: str = "raw_value") -> DataFrame:
    """A Parquet file, or the part-*.parquet files of a folder, of the archive (timestamp_unix_ns, value): seconds since the first sample. The archive holds raw values only."""
    if column != "raw_value":
        raise ValueError("the archive holds raw values only")
    d = spark.read.option("pathGlobFilter", "*.parquet" if path.endswith(".parquet") else "part-*.parquet").parquet(path).select("timestamp_unix_ns", "value", F.struct("_metadata.file_path", "_metadata.row_index").alias("nth"))
    first = d.agg(F.min("timestamp_unix_ns").alias("first_ns"))  # one row
    return d.join(F.broadcast(first)).select(((F.col("timestamp_unix_ns") - F.col("first_ns")).cast("double") / 1e9).alias("t"), F.col("value").cast("double").alias("v"), "nth")


def from_csv(spark: SparkSession, path: str, channel: int, column: str = "raw_value") -> DataFrame:
    """One channel of an exported CSV file; a missing column, and a channel without a row, raise."""
    rows = spark.read.option("header", "true").csv(path)
    token = f"ch{channel:02d}"
    out = series.csv_signal(rows.withColumn("nth", F.struct(F.monotonically_increasing_id())), token, column)
    if rows.where(F.col("channel") == token).isEmpty():
        raise ValueError(f"no rows for channel {token}")
    return out.select("t", "v", "nth")


def from_reference(spark: SparkSession, path: str, channel: int) -> DataFrame:
    """One channel of a recorder's text file; a channel that the file doesn't have raises."""
    lines = spark.read.text(path).select(F.lit(0).alias("doc"), F.monotonically_increasing_id().alias("line"), "value")
    long = series.reference_long(lines, "value", "line", "doc")
    found = sorted(r["channel"] for r in long.select("channel").distinct().collect())  # at most 14
    if channel not in found:
        raise ValueError(f"channel {channel} is not among {found}")
    return long.where(F.col("channel") == channel).select("t", "v", F.lit(0).alias("nth"))


def of_case(spark: SparkSession, folder: str):
    """A loader for suite.run: a case's `reference` (recorder text, reference_channel) and `input` (input_format csv or parquet, signal_column), relative to the suite's folder."""

    def load(case: dict, side: str) -> DataFrame:
        name = str(case[side])
        path, channel = name if name.startswith("/") or "://" in name else f"{folder}/{name}", int(case.get("reference_channel", 0))
        if side == "reference":
            return from_reference(spark, path, channel)
        kind, column = case.get("input_format", "csv"), case.get("signal_column", "raw_value")
        if kind not in ("csv", "parquet"):
            raise ValueError(f"unknown input format {kind!r}")
        return from_parquet(spark, path, column) if kind == "parquet" else from_csv(spark, path, channel, column)

    return load
