"""Scan batches: validation, de-interleaving, time stamps, clocks, sequence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewell.operators import ordered


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def batch_status(values: Column, channels: Column) -> Column:
    """`empty` for a null or empty batch, `ragged` if the channels don't divide it, else `ok`."""
    n = F.coalesce(F.size(values), F.lit(0))
    return F.when(n <= 0, "empty").when((channels <= 0) | (n % channels != 0), "ragged").otherwise("ok")


def deinterleave(df: DataFrame, values: str, channels: str) -> DataFrame:
    """One row per element of c0s0, c1s0, ..., c0s1, ...: channel_index, scan_index, value."""
    e = df.select("*", F.posexplode(values).alias("pos", "value")).drop(values)
    return e.withColumn("channel_index", F.pmod("pos", F.col(channels)).cast("bigint")).withColumn("scan_index", F.floor(F.col("pos") / F.col(channels)).cast("bigint")).drop("pos")


def expand(df: DataFrame, values: str = "values", first: str = "first_sample_unix_ns", interval: str = "sample_interval_ns") -> DataFrame:
    """One row per sample with its time; samples whose time passes the greatest BIGINT are dropped, with the rest of their batch."""
    e = df.select("*", F.posexplode(values).alias("sample_index", "value")).drop(values)
    at = F.try_add(F.col(first), F.try_multiply(F.col("sample_index").cast("bigint"), F.col(interval)))
    return e.withColumn("timestamp_unix_ns", at).where("timestamp_unix_ns is not null")


def sample_interval_ns(rate: Column) -> Column:
    """round(1e9 / rate), half away from zero; null for a rate that is not positive and finite."""
    return F.when(finite(rate) & (rate > 0), F.round(F.lit(1e9) / rate).cast("bigint"))


def stream_clock(df: DataFrame, run: str, order: str, size: Column, interval: Column, start: Column, width=None) -> DataFrame:
    """Sequence numbers 0, 1, 2, ... and the time of the first sample of each batch of a run; empty batches are rejected. order: a number without ties in a run, whose bins of `width` tasks share."""
    d = df.where(size > 0).withColumn("_span", (size * interval).cast("bigint"))
    d = ordered.running(d, [run], order, width or ordered.MILLION, _n=("count", F.lit(1)), _upto=("sum", F.col("_span")))
    out = d.withColumn("sequence", F.col("_n") - 1).withColumn("first_sample_unix_ns", (start + F.col("_upto") - F.col("_span")).cast("bigint"))
    return out.drop("_n", "_upto", "_span")


def sequence_state(df: DataFrame, key: str, arrival: str, sequence: str, width=None) -> DataFrame:
    """`first`, `ok` (previous + 1), `gap` (more) or `reset` (not more) in order of arrival, and how many are missing. Messages that arrive at the same place go by sequence number."""
    d = ordered.previous(df, [key], arrival, width or ordered.MILLION, F.col(sequence), [sequence])
    step = F.col(sequence) - F.col("previous")
    state = F.when(F.col("previous").isNull(), "first").when(step == 1, "ok").when(step > 1, "gap").otherwise("reset")
    return d.withColumn("state", state).withColumn("missing", F.when(step > 1, step - 1).otherwise(F.lit(0)).cast("bigint")).drop("previous")
