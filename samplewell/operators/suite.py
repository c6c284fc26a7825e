"""Validation of captured signals against references: comparisons of any number of pairs at once, suites of them, and their reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplewell.functions import xcorr
from samplewell.operators import ordered, series
from samplewell.operators.scans import finite
from samplewell.sources import folders

#: Grid points that one task makes.
GRID_STEP = 65_536


def cleaned(signal: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """(key, t, v) of a signal's finite samples; of samples of the same time the first by column `order` (without one, the least value)."""
    d = signal.select(key, F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v"), *([F.col(order).alias("_o")] if order else []))
    d = d.where(finite(F.col("t")) & finite(F.col("v")))
    return d.groupBy(key, "t").agg((F.min_by("v", "_o") if order else F.min("v")).alias("v"))


def stats(signal: DataFrame, key: str, width=ordered.HOUR) -> DataFrame:
    """n, start, end, dt and rate of each key's cleaned signal; dt and rate are null for fewer than two samples."""
    ends = signal.groupBy(key).agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"))
    return ends.join(series.rate(signal, key, "t", width), key, "left")


def _written(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: what follows reads it several times."""
    folders.shared_folder(df.sparkSession)
    return df.checkpoint()


def _grid(bounds: DataFrame, key: str) -> DataFrame:
    """(key, i, t): the common grid of each pair; long grids are made by many tasks."""
    parts = bounds.where("points >= 2").withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("points") - 1, F.lit(GRID_STEP).cast("bigint"))))
    d = parts.repartition(key, "_from").withColumn("i", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + GRID_STEP, F.col("points")) - 1)))
    return d.select(key, "i", (F.col("from_sec") + F.col("i") * F.col("grid_dt_sec")).alias("t"))


def align(reference: DataFrame, candidate: DataFrame, key: str, order: str | None = None, width=ordered.HOUR) -> tuple[DataFrame, DataFrame]:
    """(pairs, samples): the lag of each key's candidate (key, t, v) behind its reference (key, t, v), and the reference's samples with the shifted candidate's values.

    Both are resampled to the lower rate over their common time; the lag is where their cross-correlation is greatest, positive if the candidate
    is to be shifted later. Samples outside the time that both cover then are left out. pairs has `error` where a pair cannot be aligned.
    The cross-correlation takes one pair's grid in one task; all else is spread over bins of time of the given width.
    """
    reference, candidate = _written(cleaned(reference, key, order)), _written(cleaned(candidate, key, order))
    a, b = stats(reference, key, width), stats(candidate, key, width)
    names = ("n", "start", "end", "dt", "rate")
    both = a.select(key, *[F.col(c).alias(f"reference_{c}") for c in names]).join(b.select(key, *[F.col(c).alias(f"input_{c}") for c in names]), key, "full_outer")
    both = both.withColumn("grid_rate_hz", F.when(F.col("reference_rate").isNotNull() & F.col("input_rate").isNotNull(), F.least("reference_rate", "input_rate"))).withColumn("grid_dt_sec", 1 / F.col("grid_rate_hz"))
    both = both.withColumn("from_sec", F.greatest("reference_start", "input_start")).withColumn("to_sec", F.least("reference_end", "input_end"))
    span = F.col("to_sec") - F.col("from_sec")
    both = both.withColumn("points", F.when(span > 0, F.floor(span / F.col("grid_dt_sec")) + 1))
    both = _written(both)
    grid = _written(series.interpolate(_grid(both, key), reference, key, width=width).withColumnRenamed("input_value", "x"))
    grid = series.interpolate(grid, candidate, key, width=width).withColumnRenamed("input_value", "y")
    both = both.join(series.xcorr_lag(grid, key), key, "left").withColumn("initial_lag_sec", F.col("lag_samples") * F.col("grid_dt_sec"))
    error = (
        F.when(F.col("grid_rate_hz").isNull(), "fewer than two samples").when(F.col("points").isNull(), "the signals do not overlap in time")
        .when(F.col("points") < 2, "not enough samples on the common grid").when(F.col("lag_samples").isNull(), "a constant signal cannot be aligned")
    )
    both = _written(both.withColumn("error", error).withColumnRenamed("points", "grid_samples").drop("from_sec", "to_sec"))
    shifted = candidate.join(both.where("error is null").select(key, "initial_lag_sec"), key).select(key, (F.col("t") + F.col("initial_lag_sec")).alias("t"), "v")
    points = reference.withColumnRenamed("v", "reference_value")
    return both, _written(series.interpolate(points, shifted, key, width=width).where("input_value is not null"))


def metrics(pairs: DataFrame, samples: DataFrame, key: str, width=ordered.HOUR) -> DataFrame:
    """One row per pair of align(): its statistics and lag, the error metrics, the drift of lag and amplitude, and `error`, why there are none."""
    errors = series.summary(samples, key)
    drifts = drift(samples, pairs.select(key, "reference_rate"), key, width)
    out = pairs.withColumnRenamed("error", "_error").join(errors, key, "left").join(drifts, key, "left")
    error = F.coalesce("_error", F.when(F.coalesce("n", F.lit(0)) < 2, "fewer than two aligned samples"), F.when(F.col("constant_windows") > 0, "a window is constant"))
    return out.withColumn("error", error).drop("_error", "constant_windows")


def drift(samples: DataFrame, rates: DataFrame, key: str, width=ordered.HOUR) -> DataFrame:
    """Slopes of lag and amplitude ratio over half-overlapping windows of half a second (8 samples at least), and the mean ratio; how many windows are constant."""
    d = samples.join(rates, key).withColumn("_size", F.greatest(F.lit(8.0), F.bround(0.5 * F.col("reference_rate"), 0)).cast("bigint"))  # half to even
    w = series.windows(d, key, "t", F.col("_size"), width)
    kind = samples.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.DoubleType()) for c in ("center", "lag", "ratio")]])
    per = w.select(key, "window_start", "t", "reference_value", "input_value").groupBy(key, "window_start").applyInPandas(_window, schema)
    per = _written(per).join(rates, key).withColumn("lag", F.col("lag") / F.col("reference_rate"))
    slopes = series.slope(per, key, "center", "lag").select(key, F.col("slope").alias("lag_sec_per_sec")).join(series.slope(per, key, "center", "ratio").select(key, F.col("slope").alias("amplitude_ratio_per_sec")), key)
    return slopes.join(per.groupBy(key).agg(F.avg("ratio").alias("mean_amplitude_ratio"), F.count(F.when(F.col("lag").isNull(), 1)).alias("constant_windows")), key)


def _window(key, pdf):
    import pandas as pd

    pdf = pdf.sort_values("t")
    x, y = pdf["reference_value"].to_numpy(float), pdf["input_value"].to_numpy(float)
    lag = xcorr.best_lag(x, y)
    ratio = None if lag is None else y.std() / x.std()
    return pd.DataFrame({pdf.columns[0]: [key[0]], "center": [pdf["t"].mean()], "lag": pd.array([lag], "Float64"), "ratio": pd.array([ratio], "Float64")})


def compare(reference: DataFrame, candidate: DataFrame) -> dict:
    """All metrics of one candidate (t, v) against its reference (t, v). Constant signals, no overlap and fewer than two aligned samples raise ValueError."""
    keyed = [s.withColumn("k", F.lit(0).cast("bigint")) for s in (reference, candidate)]
    found = metrics(*align(*keyed, "k"), "k").drop("k").first()
    if found is None or found["error"]:
        raise ValueError(found["error"] if found else "no samples")
    return found.asDict()


def run(spark: SparkSession, config: str, load: Callable[[dict, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Run a suite given as JSON (defaults with thresholds, cases); load(case, "reference" | "input") gives a signal (t, v).

    Returns (checks, report). All cases are compared in one job. A case that raises fails with its error and does not stop the others (if
    the job fails, they run one by one); an unknown threshold is an error of its case.
    """
    suite = json.loads(config)
    defaults, checked, reported, signals = suite.get("defaults", {}), [], {}, {}
    cases = [defaults | case | {"name": str(case.get("name") or f"case_{k + 1:02d}"), "thresholds": defaults.get("thresholds", {}) | case.get("thresholds", {})} for k, case in enumerate(suite["cases"])]

    def failed(k: int, error: str) -> None:
        reported[k] = (cases[k]["name"], False, "", error[:500])

    for k, case in enumerate(cases):
        try:
            if unknown := [n for n in case["thresholds"] if n not in series.THRESHOLDS]:
                raise ValueError(f"unknown threshold {unknown[0]!r}")
            signals[k] = tuple(load(case, side).select(F.lit(k).cast("bigint").alias("k"), "t", "v") for side in ("reference", "input"))
        except Exception as e:  # kept as the case's result
            failed(k, f"{type(e).__name__}: {e}")

    def results(some: list[int]) -> dict:
        reference, candidate = signals[some[0]]
        for k in some[1:]:
            reference, candidate = reference.union(signals[k][0]), candidate.union(signals[k][1])
        return {r["k"]: r for r in metrics(*align(reference, candidate, "k"), "k").collect()}  # one row a case

    try:
        found = results(list(signals)) if signals else {}
    except Exception:
        found = {}
        for k in signals:
            try:
                found |= results([k])
            except Exception as e:  # kept as the case's result
                failed(k, f"{type(e).__name__}: {e}")
    for k in signals:
        if k in reported:
            continue
        if k not in found or found[k]["error"]:
            failed(k, f"ValueError: {found[k]['error'] if k in found else 'no samples'}")
            continue
        row = spark.createDataFrame([(cases[k]["name"], *(None if found[k][m] is None else float(found[k][m]) for m in _METRICS))], "name string, " + ", ".join(f"{m} double" for m in _METRICS))
        own = series.checks(row, "name", list(cases[k]["thresholds"].items())).orderBy("nth").collect() if cases[k]["thresholds"] else []
        checked += [(cases[k]["name"], c["threshold"], c["metric"], c["op"], c["value"], c["limit"], c["passed"]) for c in own]
        reported[k] = (cases[k]["name"], all(c["passed"] for c in own), ",".join(c["threshold"] for c in own if not c["passed"]), None)
    return (
        spark.createDataFrame(checked, "name string, threshold string, metric string, op string, value double, limit double, passed boolean"),
        spark.createDataFrame([reported[k] for k in sorted(reported)], "name string, passed boolean, failed string, error string"),
    )


_METRICS = sorted({m for m, _ in series.THRESHOLDS.values()})


def write_reports(checks: DataFrame, report: DataFrame, path: str) -> None:
    """Checks and report as JSON lines and as CSV with headers."""
    for name, d in (("checks", checks), ("report", report)):
        d.coalesce(1).write.mode("overwrite").json(f"{path}/{name}.json")
        d.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/{name}.csv")


def write_comparison(summary: DataFrame, samples: DataFrame, key: str, path: str) -> None:
    """Results of align() and metrics(): the summary as JSON and as one CSV row per pair, and the aligned samples with their errors as CSV in a folder for each pair."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary.json")
    summary.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/summary.csv")
    error = F.col("input_value") - F.col("reference_value")
    rows = samples.select(key, F.col("t").alias("time_sec"), "reference_value", "input_value", error.alias("error"), F.abs(error).alias("abs_error"), series.relative_error(error, F.col("reference_value")).alias("relative_error"))
    rows.repartitionByRange(key, "time_sec").sortWithinPartitions(key, "time_sec").write.mode("overwrite").partitionBy(key).option("header", "true").csv(f"{path}/aligned_samples")
