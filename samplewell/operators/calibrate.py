"""Calibrations as structs (id, type, a, b, coeffs) and their application as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewell.functions import timefmt
from samplewell.operators.scans import finite

SPEC = "id string, type string, a double, b double, coeffs array<double>"


def polynomial(x: Column, coeffs: Column) -> Column:
    """Sum of c_i x^i, lowest order first (Horner from the highest)."""
    return F.aggregate(F.reverse(coeffs), F.lit(0.0), lambda acc, c: acc * x + c)


def polynomial_of(x: Column, coeffs: list[float]) -> Column:
    """The same with known coefficients, unrolled when the plan is made."""
    out = F.lit(0.0)
    for c in reversed(coeffs):
        out = out * x + F.lit(float(c))
    return out


def apply(x: Column, spec: Column) -> Column:
    """Identity, a x + b or a polynomial; an unknown type is the identity; null spec too. A raw value that isn't finite comes back unchanged."""
    return F.when(~finite(x), x).when(spec["type"] == "linear", spec["a"] * x + spec["b"]).when(spec["type"] == "polynomial", polynomial(x, spec["coeffs"])).otherwise(x)


def normalize(spec: Column) -> Column:
    """Unknown types become identity; a and b default to 1 and 0; coefficients that aren't finite go, none left means [0, 1]."""
    kept = F.filter(F.coalesce(spec["coeffs"], F.array().cast("array<double>")), lambda c: finite(c))
    kind = F.when(spec["type"].isin("linear", "polynomial"), spec["type"]).otherwise("identity")
    number = lambda c, d: F.when(finite(c), c).otherwise(F.lit(d))
    return F.struct(
        spec["id"].alias("id"), kind.alias("type"), F.when(kind == "linear", number(spec["a"], 1.0)).alias("a"), F.when(kind == "linear", number(spec["b"], 0.0)).alias("b"),
        F.when(kind == "polynomial", F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(0.0), F.lit(1.0)))).alias("coeffs"),
    )


def explode_map(df: DataFrame, column: str) -> DataFrame:
    """Map of channel text -> spec as rows (channel, spec); keys that are no number from 0 to 255 are dropped."""
    e = df.select("*", F.explode(column).alias("channel_key", "spec"))
    return e.withColumn("channel", F.expr("try_cast(channel_key as int)")).where("channel between 0 and 255").drop("channel_key", column)


def with_calibration(samples: DataFrame, dimension: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Left join with a small dimension (columns `on` and spec): calibrated_value and calibration_id, identity where there is none."""
    spec = F.col("spec")
    return samples.join(dimension, on, "left").withColumn("calibrated_value", apply(F.col(value), spec)).withColumn("calibration_id", F.coalesce(spec["id"], F.lit("identity"))).drop("spec")


def as_of(samples: DataFrame, intervals: DataFrame, time: str = "timestamp_unix_ns", bin_ns: int = 86_400_000_000_000) -> DataFrame:
    """Join each sample with the spec in effect at its time: intervals (channel, effective_from_ns, effective_to_ns or null, spec).

    Time is cut into bins, so the join is by (channel, bin) with the bounds as a residual test; an interval is repeated for
    each bin between its ends and the samples' range.
    """
    span = samples.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    if span["lo"] is None:
        lo = hi = 0
    else:
        lo, hi = span["lo"] // bin_ns, span["hi"] // bin_ns
    first = F.greatest(F.lit(lo), timefmt.floor_div(F.col("effective_from_ns"), bin_ns))
    last = F.least(F.lit(hi), timefmt.floor_div(F.coalesce(F.col("effective_to_ns"), F.lit((hi + 1) * bin_ns)), bin_ns))
    binned = intervals.withColumn("bin", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    s = samples.withColumn("bin", timefmt.floor_div(F.col(time), bin_ns))
    t = F.col(time)
    on = (s["channel"] == binned["channel"]) & (s["bin"] == binned["bin"]) & (t >= F.col("effective_from_ns")) & (F.col("effective_to_ns").isNull() | (t < F.col("effective_to_ns")))
    return s.join(binned, on, "left").drop(binned["channel"]).drop("bin", "effective_from_ns", "effective_to_ns")
