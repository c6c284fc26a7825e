"""Threshold triggers: edges, windows, pre-buffer, hold-off, captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplewell.functions import timefmt
from samplewell.operators import ordered


def windows(post_sec: Column, pre_percent: Column) -> tuple[Column, Column]:
    """(pre, post) in seconds: post at least 0.01, the share before the trigger within 0..0.95 of the whole."""
    post = F.greatest(F.lit(0.01), post_sec)
    f = F.least(F.lit(0.95), F.greatest(F.lit(0.0), pre_percent / 100))
    return post * f / (1 - f), post


def edges(df: DataFrame, key: str, time: str, value: str, threshold: float, rising: bool = True, order: str | None = None, width=ordered.HOUR_NS) -> DataFrame:
    """Rows whose value leaves the threshold upwards (downwards), coming from at or beyond its other side; a first row never does. Rows of equal time go by column `order` (without one, by value)."""
    d, v, t = ordered.previous(df, [key], time, width, F.col(value), [order or value]), F.col(value), F.lit(threshold)
    return d.where((F.col("previous") <= t) & (v > t) if rising else (F.col("previous") >= t) & (v < t))


def prebuffer_ready(df: DataFrame, key: str, time: str, pre: int, order: str | None = None, width=ordered.HOUR_NS) -> DataFrame:
    """ready: at least two rows so far, and the first lies `pre` or more before. Rows of equal time go by column `order`."""
    d = ordered.running(df, [key], time, width, [order] if order else [], _n=("count", F.lit(1)), _first=("min", F.col(time)))
    return d.withColumn("ready", (F.col("_n") >= 2) & (F.col(time) - F.col("_first") >= pre)).drop("_n", "_first")


def single(found: DataFrame, key: str, time: str) -> DataFrame:
    """The first edge of each key."""
    return found.groupBy(key).agg(F.min(time).alias("trigger_ns"))


def held_off(found: DataFrame, key: str, time: str, post: int) -> DataFrame:
    """Normal mode: an edge counts if it comes `post` or more after the last that counted. Each key's edges are gone through in order, batch by batch: only the last trigger is held."""
    kind = found.schema[key].dataType

    def run(batches):
        import pyarrow as pa

        own = last = None
        for b in batches:
            keys, times = b.column(0).to_pylist(), b.column(1).to_pylist()
            taken = []
            for k, t in zip(keys, times):
                if k != own or last is None or t >= last + post:
                    taken.append((k, t))
                    own, last = k, t
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in taken], b.schema.field(0).type), pa.array([t for _, t in taken], pa.int64())], names=[key, "trigger_ns"])

    rows = found.select(key, F.col(time).cast("bigint").alias("t")).where(F.col(key).isNotNull() & F.col("t").isNotNull()).repartition(key).sortWithinPartitions(key, "t")
    return rows.mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("trigger_ns", T.LongType())]))


def capture(samples: DataFrame, triggers: DataFrame, key: str, time: str, pre: int, post: int) -> DataFrame:
    """Samples of [trigger - pre, trigger + post], both included, for each trigger (key, trigger_ns); joined by bins of the window's width."""
    bin_ = max(1, pre + post)
    t = triggers.withColumn("_bin", F.explode(F.sequence(timefmt.floor_div(F.col("trigger_ns") - pre, bin_), timefmt.floor_div(F.col("trigger_ns") + post, bin_))))
    s = samples.withColumn("_bin", timefmt.floor_div(F.col(time), bin_))
    return s.join(t, [key, "_bin"]).where(F.col(time).between(F.col("trigger_ns") - pre, F.col("trigger_ns") + post)).drop("_bin")
