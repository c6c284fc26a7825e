"""Windows over event time with watermarks: tumbling, sliding and session windows of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewell.functions.timefmt import floor_div


def event_time(stream: DataFrame, late: str, time: str = "timestamp_unix_ns") -> DataFrame:
    """The stream with column event_time (microseconds, floored) and a watermark: samples later than `late` behind the newest are dropped by the windows below."""
    return stream.withColumn("event_time", F.timestamp_micros(floor_div(F.col(time), 1000))).withWatermark("event_time", late)


def _aggregates(value: str) -> list[Column]:
    return [F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean")]


def windowed(stream: DataFrame, width: str, late: str, slide: str | None = None, key: str = "channel", value: str = "value") -> DataFrame:
    """n, low, high and mean of each key in tumbling windows, or in sliding ones that begin every `slide`."""
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    out = event_time(stream, late).groupBy(key, w.alias("w")).agg(*_aggregates(value))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "low", "high", "mean")


def sessions(stream: DataFrame, gap: str, late: str, key: str = "channel", value: str = "value") -> DataFrame:
    """n, low, high and mean of each key in sessions: runs of samples without a pause of `gap` or more. A pause of a device ends a session."""
    out = event_time(stream, late).groupBy(key, F.session_window("event_time", gap).alias("w")).agg(*_aggregates(value))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "low", "high", "mean")
