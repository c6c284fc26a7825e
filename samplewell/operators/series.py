"""Signals: loading, cleaning, rates, detrending, interpolation, lag, windows, error metrics, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplewell.functions import timefmt
from samplewell.operators import ordered
from samplewell.operators.scans import finite

#: Fixed value: the least divisor of a relative error (double precision's unit).
EPSILON = 2.220446049250313e-16
#: Threshold -> (metric, comparison).
THRESHOLDS = {
    "max_rmse": ("rmse", "<="), "max_mae": ("mae", "<="), "max_abs_error": ("max_abs_error", "<="), "max_max_abs_error": ("max_abs_error", "<="),
    "max_abs_error_p95": ("abs_error_p95", "<="), "max_abs_error_p99": ("abs_error_p99", "<="), "max_mean_relative_error": ("mean_relative_error", "<="),
    "max_relative_error_p95": ("relative_error_p95", "<="), "max_relative_error_p99": ("relative_error_p99", "<="), "min_pearson_correlation": ("pearson_correlation", ">="),
    "max_abs_initial_lag_sec": ("initial_lag_sec", "abs<="), "max_abs_lag_sec_per_sec": ("lag_sec_per_sec", "abs<="), "max_abs_amplitude_ratio_per_sec": ("amplitude_ratio_per_sec", "abs<="),
}
NAN = float("nan")


def csv_signal(rows: DataFrame, channel: str, column: str, timestamp: str = "timestamp") -> DataFrame:
    """One channel of text rows as (.., t, v): seconds since the first kept row. Rows whose time or number can't be read, or isn't finite, go."""
    for c in (timestamp, "channel", column):
        if c not in rows.columns:
            raise ValueError(f"column {c} is missing")
    d = rows.where(F.col("channel") == channel).withColumn("ns", timefmt.parse_rfc3339(F.col(timestamp))).withColumn("v", F.col(column).try_cast("double")).where(F.col("ns").isNotNull() & finite(F.col("v")))
    first = d.agg(F.min("ns").alias("first_ns"))
    return d.join(F.broadcast(first)).withColumn("t", (F.col("ns") - F.col("first_ns")).cast("double") / 1e9).drop("first_ns", "ns", timestamp, "channel", column)  # one row on the right


def reference_long(lines: DataFrame, text: str, order: str, key: str, cap: int = 14) -> DataFrame:
    """Recorder text as (key, t, channel, v): per line comma, tab or white space; a header whose first field is `time` begins the data.

    Kept are lines of the header's width (cut at `cap` channels) with finite numbers only; of lines of the same time the first.
    """
    s = F.regexp_replace(F.trim(text), "^﻿", "")
    fields = F.when(F.contains(s, F.lit(",")), F.split(s, ",")).when(F.contains(s, F.lit("\t")), F.split(s, "\t")).otherwise(F.split(s, r"\s+"))
    d = lines.withColumn("f", F.transform(fields, lambda x: F.trim(x)))
    head = d.where(F.lower(F.col("f")[0]) == "time").groupBy(key).agg(F.min(F.struct(F.col(order).alias("at"), F.size("f").alias("width"))).alias("h"))
    numbers = F.transform("f", lambda x: x.try_cast("double"))
    body = d.join(head, key).where(F.col(order) > F.col("h.at")).withColumn("x", numbers).where((F.size("x") == F.col("h.width")) & F.forall("x", finite))
    first = body.withColumn("t", F.col("x")[0]).withColumn("rn", F.row_number().over(Window.partitionBy(key, "t").orderBy(order))).where("rn = 1")
    values = F.slice("x", 2, F.least(F.size("x") - 1, F.lit(cap)))
    return first.select(key, "t", F.posexplode(values).alias("channel", "v"))


def dedupe_first(df: DataFrame, key: list[str], time: str, order: str) -> DataFrame:
    """Of rows of the same time, the first by `order`."""
    w = Window.partitionBy(*key, time).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rate(df: DataFrame, key: str, time: str, width=ordered.HOUR_NS) -> DataFrame:
    """dt: median of the positive differences of time; rate: 1 / dt. Equal times differ by 0 and don't count. width: bins of time that tasks share."""
    d = ordered.previous(df.select(key, time), [key], time, width, F.col(time)).withColumn("d", F.col(time) - F.col("previous")).where("d > 0")
    return ordered.quantiles(d, [key], "d", {"dt": 0.5}).withColumn("rate", 1 / F.col("dt"))


def detrended(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, and RMS about it, of each key; a constant or empty signal has a null RMS (nothing can be normalised by it)."""
    rms = F.stddev_pop(value)
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.when(rms > 1e-12, rms).alias("rms"))


def interpolate(points: DataFrame, candidate: DataFrame, key: str, time: str = "t", value: str = "v", order: str | None = None, width=ordered.HOUR) -> DataFrame:
    """points (key, t, ..) with the candidate's (key, t, v) value at t, linear between its neighbours, null outside its range.

    Union, and windows that carry the last known candidate forwards and backwards, in bins of time. Of candidates of the
    same time the first by column `order` counts (without one, that of the least value).
    """
    extra = [c for c in points.columns if c not in (key, time)]
    point = lambda t, v: F.struct(t.cast("double").alias("t"), v.cast("double").alias("v"))
    nth = F.rank().over(Window.partitionBy(key, time).orderBy(order or value))
    a = points.withColumn("_p", F.lit(None).cast("struct<t:double,v:double>")).withColumn("_is", F.lit(True))
    b = candidate.withColumn("_nth", nth).where("_nth = 1").select(key, time, *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra], point(F.col(time), F.col(value)).alias("_p"), F.lit(False).alias("_is"))
    u = a.select(key, time, *extra, "_p", "_is").unionByName(b)
    u = ordered.running(u, [key], time, width, ["_is"], _l=("last", F.col("_p")), _r=("last", F.col("_p"), "back")).where("_is")
    l, r, t = F.col("_l"), F.col("_r"), F.col(time).cast("double")
    v = F.when(l["t"] == t, l["v"]).when(r["t"] == t, r["v"]).otherwise(l["v"] + (r["v"] - l["v"]) * (t - l["t"]) / (r["t"] - l["t"]))
    return u.select(key, time, *extra, v.alias("input_value"))


def overlap(reference: DataFrame, candidate: DataFrame, key: str, time: str, lag: Column | float = 0) -> DataFrame:
    """n and m (rows of both sides), and the start and end of the time that both cover, the candidate's moved later by `lag`; end before start means none."""
    ends = [F.count("*").alias("n"), F.min(time).alias("a"), F.max(time).alias("b")]
    r, c = reference.groupBy(key).agg(*ends), candidate.groupBy(key).agg(*ends).toDF(key, "m", "ca", "cb")
    return r.join(c, key).select(key, "n", "m", F.greatest(F.col("a"), F.col("ca") + lag).alias("start"), F.least(F.col("b"), F.col("cb") + lag).alias("end"))


def pearson(x: str, y: str) -> Column:
    """Correlation; NaN if a side is constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.coalesce(F.when((sx > 1e-12) & (sy > 1e-12), F.try_divide(F.covar_pop(x, y), sx * sy)), F.lit(NAN))


def relative_error(error: Column, reference: Column) -> Column:
    return F.abs(error) / F.greatest(F.abs(reference), F.lit(EPSILON))


def summary(aligned: DataFrame, key: str) -> DataFrame:
    """Error metrics of rows (key, reference_value, input_value); the percentiles are exact."""
    d = aligned.withColumn("e", F.col("input_value") - F.col("reference_value"))
    d = d.withColumn("a", F.abs("e")).withColumn("r", relative_error(F.col("e"), F.col("reference_value")))
    out = d.groupBy(key).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("a").alias("mae"), F.max("a").alias("max_abs_error"), F.avg("e").alias("mean_error"), F.stddev_pop("e").alias("std_error"),
        F.min("e").alias("min_error"), F.max("e").alias("max_error"), F.avg("r").alias("mean_relative_error"), pearson("reference_value", "input_value").alias("pearson_correlation"),
    )
    for c, name in (("a", "abs_error"), ("r", "relative_error")):
        out = out.join(ordered.quantiles(d, [key], c, {f"{name}_p{p}": p / 100 for p in (50, 95, 99)}), key)
    return out


def best_lag(df: DataFrame, key: list[str], index: str, x: str, y: str, most: int) -> DataFrame:
    """The lag of at most `most` samples whose sum of x[i] y[i - lag] is greatest (the least lag of equals); x and y without their means.

    For short windows: a key's rows (index, x, y) are gathered in one array, and each lag is a fold over it.
    """
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(index).cast("bigint").alias("i"), F.col(x).alias("x"), F.col(y).alias("y")))).alias("r"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    rows = rows.select(*key, F.transform("r", lambda p: p["x"] - F.col("mx")).alias("x"), F.transform("r", lambda p: p["y"] - F.col("my")).alias("y"))
    least, last = F.greatest(F.lit(-most), 1 - F.size("x")), F.least(F.lit(most), F.size("x") - 1)
    product = F.expr("round(aggregate(zip_with(slice(x, greatest(0, lag) + 1, size(x) - abs(lag)), slice(y, greatest(0, -lag) + 1, size(y) - abs(lag)), (a, b) -> a * b), 0D, (s, p) -> s + p), 6)")
    each = rows.withColumn("lag", F.explode(F.sequence(least, last))).select(*key, F.col("lag").cast("bigint").alias("lag"), product.alias("c"))
    return each.groupBy(*key).agg(F.min_by("lag", F.struct(-F.col("c"), F.col("lag"))).alias("lag_samples"))


def xcorr_lag(pairs: DataFrame, key: str) -> DataFrame:
    """Full cross-correlation by FFT of each key's grid (i, x, y): lag in samples, its value confirmed by direct sums around the peak. A constant side gives null."""
    from samplewell.functions.xcorr import lag_of_group

    return pairs.select(key, "i", "x", "y").groupBy(key).applyInPandas(lag_of_group, T.StructType([T.StructField(key, pairs.schema[key].dataType), T.StructField("lag_samples", T.LongType())]))


def windows(df: DataFrame, key: str, order: str, size: int | Column, width=ordered.HOUR) -> DataFrame:
    """Rows of half-overlapping windows of `size` rows (or all, if fewer): window_start is the first row's number. The last window ends at the last row."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    d = ordered.numbered(df, [key], order, width).join(n, key)
    size_ = F.least((size if isinstance(size, Column) else F.lit(size)).cast("bigint"), F.col("n"))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(size_ / 2))
    last = F.col("n") - size_
    low = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("i") - size_ + 1) / step) * step)
    high = F.least(F.floor(F.col("i") / step) * step, F.floor(last / step) * step)
    regular = F.when(low <= high, F.sequence(low, high, step)).otherwise(F.array().cast("array<bigint>"))
    starts = F.array_distinct(F.concat(regular, F.when(F.col("i") >= last, F.array(last)).otherwise(F.array().cast("array<bigint>"))))
    return d.withColumn("window_start", F.explode(starts)).drop("n")


def slope(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept; one row gives (0, its value), none NaN."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return df.groupBy(key).agg(F.when(n == 0, F.lit(NAN)).when(n == 1, F.lit(0.0)).otherwise(F.regr_slope(y, x)).alias("slope"), F.when(n == 0, F.lit(NAN)).when(n == 1, F.max(y)).otherwise(F.regr_intercept(y, x)).alias("intercept"))


def checks(metrics: DataFrame, key: str, thresholds: list[tuple[str, float]]) -> DataFrame:
    """One row per key and threshold: metric, op, value, limit, passed. NaN and null never pass; an unknown threshold raises."""
    for name, _ in thresholds:
        if name not in THRESHOLDS:
            raise ValueError(f"unknown threshold {name!r}")
    rows = [F.struct(F.lit(k).alias("nth"), F.lit(n).alias("threshold"), F.lit(THRESHOLDS[n][0]).alias("metric"), F.lit(THRESHOLDS[n][1]).alias("op"), F.col(THRESHOLDS[n][0]).cast("double").alias("value"), F.lit(float(v)).alias("limit")) for k, (n, v) in enumerate(thresholds)]
    d = metrics.select(key, F.explode(F.array(*rows)).alias("c")).select(key, "c.*")
    compared = F.when(F.col("op") == "abs<=", F.abs("value")).otherwise(F.col("value"))
    passed = F.when(F.col("value").isNull() | F.isnan("value"), False).when(F.col("op") == ">=", compared >= F.col("limit")).otherwise(compared <= F.col("limit"))
    return d.withColumn("passed", passed)


def report(checked: DataFrame, key: str) -> DataFrame:
    """passed, and the failed thresholds in their order, for each key."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("nth", "threshold"))))
    return checked.groupBy(key).agg(F.bool_and("passed").alias("passed"), F.array_join(F.transform(failed, lambda x: x["threshold"]), ",").alias("failed"))
