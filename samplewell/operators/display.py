"""What a live view shows: downsampling, ranges, axes, buffers, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplewell.operators import ordered
from samplewell.operators.scans import finite


def downsample_minmax(df: DataFrame, key: str, time: str, value: str, pixels: int, order: str | None = None, width=ordered.HOUR_NS) -> DataFrame:
    """Least and greatest row of each of max(16, pixels) runs of rows, once if they are the same; all rows if there are no more than twice as many. Rows of equal time go by column `order` (without one, by value)."""
    buckets = max(16, pixels)
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    d = ordered.numbered(df, [key], time, width, [order or value]).join(n, key)
    d = d.withColumn("bucket", F.when(F.col("n") <= 2 * buckets, F.col("i")).otherwise(F.floor(F.col("i") / F.ceil(F.col("n") / buckets))).cast("bigint"))
    p = F.struct(F.col(time).alias("time"), F.col(value).alias("value"))
    ends = d.groupBy(key, "bucket").agg(F.min_by(p, F.struct(value, time)).alias("a"), F.min_by(p, F.struct(-F.col(value), F.col(time))).alias("b"))
    return ends.select(key, F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select(key, F.col("p.time").alias(time), F.col("p.value").alias(value))


def value_range(df: DataFrame, key: str, value: str) -> DataFrame:
    """Least and greatest finite value; nulls if there is none."""
    v = F.when(finite(F.col(value)), F.col(value))
    return df.groupBy(key).agg(F.min(v).alias("low"), F.max(v).alias("high"))


def nice_step(x: Column) -> Column:
    """1, 2, 5 or 10 times a power of ten, not below x nor 0.01."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    f = F.round(x / power, 9)
    step = F.when(f <= 1, 1.0).when(f <= 2, 2.0).when(f <= 5, 5.0).otherwise(10.0) * power
    return F.when(finite(x) & (x > 0), F.greatest(F.lit(0.01), step)).otherwise(0.01)


def axis(low: Column, high: Column, divisions: int = 8) -> tuple[Column, Column, Column]:
    """(low, high, step) of an axis of nice steps around a range padded by a fifth."""
    span = F.greatest(high - low, F.lit(0.01 * divisions)) * 1.2
    step = nice_step(span / divisions)
    base = F.round(F.floor(((low + high) / 2 - step * divisions / 2) / step) * step, 6)
    return base, F.round(base + step * divisions, 6), step


def axis_decimals(step: Column) -> Column:
    return F.when(step >= 1, F.lit(2)).otherwise(F.least(F.lit(6), F.greatest(F.lit(2), F.ceil(F.round(-F.log10(step), 9)).cast("int"))))


def last_rows(df: DataFrame, key: str, time: str, n: int, order: str | None = None) -> DataFrame:
    """The newest n rows of each key; of rows of equal time those last by column `order`. The best n of each task come first, so that no task sorts a whole key."""
    by = [F.desc(time), *([F.desc(order)] if order else [])]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("_n") <= n).drop("_n")


def running_extrema(df: DataFrame, key: str, time: str, value: str, order: str | None = None, width=ordered.HOUR_NS) -> DataFrame:
    """low and high: the least and greatest value so far."""
    return ordered.running(df, [key], time, width, [order] if order else [], low=("min", F.col(value)), high=("max", F.col(value)))


def axis_position(x: Column, low: Column, span: Column, start: float, length: float, inverted: bool = False) -> Column:
    """Pixels of a value on an axis of `length` pixels from `start`; inverted: the greatest value comes first, as on a screen's y axis."""
    share = (x - low) / span
    return start + ((1 - share) if inverted else share) * length


def auto_window(rate: Column) -> tuple[Column, Column]:
    """(seconds shown, points kept) for a rate: 1000 samples but 0.05 s at least, one second for a rate that isn't positive and finite; twice as many points."""
    ok = finite(rate) & (rate > 0)
    window = F.when(ok, F.greatest(F.lit(0.05), 1000.0 / F.when(ok, rate))).otherwise(1.0)
    return window, F.ceil(rate * 2.0 * window).cast("bigint")


def effective_rate(df: DataFrame, key: str, time: str, per: int) -> DataFrame:
    """rate: rows of each key in `per` units of time, by its first and last time; keys without a span have none."""
    d = df.groupBy(key).agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("span")).where("span > 0")
    return d.select(key, F.round(F.lit(float(per)) * F.col("n") / F.col("span")).cast("bigint").alias("rate"))


def nearest_point(df: DataFrame, key: str, time: str, at: Column, column: str) -> DataFrame:
    """The value of `column` in each key's row nearest to the time `at`, the earlier of two as near."""
    return df.groupBy(key).agg(F.min_by(column, F.struct(F.abs(F.col(time) - at), F.col(time))).alias(column))


def pick_channels(df: DataFrame, key: str, channel: str, preferred: list[int], n: int = 2) -> DataFrame:
    """The first n channels of each key: those selected before first, then by number."""
    w = Window.partitionBy(key).orderBy(F.when(F.col(channel).isin(preferred), 0).otherwise(1) if preferred else F.lit(0), channel)
    return df.select(key, channel).distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def within_cap(df: DataFrame, key: str, newest: list[str], size: str, cap) -> DataFrame:
    """The newest rows of each key whose sizes add up to no more than the cap; older ones are discarded. newest: columns whose descending order is that from new to old."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in newest]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= cap).drop("_sum")


def look_back(df: DataFrame, key: str, time: str, keep: int) -> DataFrame:
    """Rows of each key not older than its newest by more than `keep`."""
    newest = df.groupBy(key).agg(F.max(time).alias("_newest"))
    return df.join(newest, key).where(F.col(time) >= F.col("_newest") - keep).drop("_newest")


def segments(df: DataFrame, key: str, time: str, x: str, width: float, order: str = "_order", bins=ordered.MILLION) -> DataFrame:
    """segment: number of the line that a point belongs to; a new one at the first point, at time that doesn't rise, and at a jump over a quarter of the width. Points go by column `order`, whose bins tasks share."""
    d = ordered.previous(df, [key], order, bins, F.struct(F.col(time).alias("t"), F.col(x).alias("x")))
    p = F.col("previous")
    starts = p.isNull() | (F.col(time) <= p["t"]) | (F.abs(F.col(x) - p["x"]) > 0.25 * width)
    return ordered.running(d, [key], order, bins, segment=("sum", starts.cast("bigint"))).drop("previous")
