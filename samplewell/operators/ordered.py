"""Running values over the rows of a key in order of time, without a task that holds a whole key.

Rows are dealt to bins of the first order column, so that a task has a key's rows of one bin. What passes from bin to bin
(counts, sums, extrema, last values) is found from one row per bin and joined back, so that the input is read twice: write long chains in between. The rest of the order breaks ties; rows that are
equal in all of it count as interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplewell.functions.timefmt import NS, floor_div

#: Bins of an hour of nanoseconds, of an hour of seconds, and of a million numbers.
HOUR_NS, HOUR, MILLION = 3600 * NS, 3600.0, 1_000_000


def bin_of(x: Column, width) -> Column:
    """Number of the bin: integer arithmetic for an integer width, else that of DOUBLE."""
    return floor_div(x, width) if isinstance(width, int) else F.floor(x / width)


def _order(time: str, ties: list, descending: bool) -> list[Column]:
    return [-F.col(time) if descending else F.col(time), *[F.col(t) if isinstance(t, str) else t for t in ties]]


def running(df: DataFrame, keys: list[str], time: str, width, ties: list = (), **wanted: tuple) -> DataFrame:
    """df with a column for each of `wanted`: name=(kind, value), over the rows up to and with this one, by time, then by ties (names or Columns).

    Kinds: count (rows), sum, min, max, last (not null). (kind, value, "back") goes from the last time to the first instead; ties stay ascending.
    """
    kinds, back = [w[0] for w in wanted.values()], [w[2:] == ("back",) for w in wanted.values()]
    names = [f"_in_{n}" for n in wanted]
    values = [(F.lit(1).cast("bigint") if k == "count" else w[1]).alias(n) for n, k, w in zip(names, kinds, wanted.values())]
    d = df.withColumn("_bin", bin_of(F.col(time), width)).select("*", *values)
    within = {b: Window.partitionBy(*keys, "_bin").orderBy(*_order(time, ties, b)).rowsBetween(Window.unboundedPreceding, 0) for b in set(back)}
    earlier = {b: Window.partitionBy(*keys).orderBy(-F.col("_bin") if b else F.col("_bin")).rowsBetween(Window.unboundedPreceding, -1) for b in set(back)}
    ends = d.groupBy(*keys, "_bin").agg(*[_whole(k, n, F.struct(*_order(time, ties, b))).alias(n) for k, n, b in zip(kinds, names, back)])
    heads = ends.select(*keys, "_bin", *[_over(k, n, earlier[b]).alias(f"{n}_before") for k, n, b in zip(kinds, names, back)])
    rows = d.select(*[c for c in d.columns if c not in names], *[_over(k, n, within[b]).alias(n) for k, n, b in zip(kinds, names, back)])
    both = rows.join(heads, [*keys, "_bin"])
    return both.select(*[c for c in df.columns if c not in wanted], *[_joined(k, F.col(f"{n}_before"), F.col(n)).alias(out) for k, n, out in zip(kinds, names, wanted)])


def previous(df: DataFrame, keys: list[str], time: str, width, value: Column, ties: list = ()) -> DataFrame:
    """df with column `previous`: the value (of any type) of the row before, null for a key's first."""
    order = _order(time, ties, False)
    d = df.withColumn("_bin", bin_of(F.col(time), width)).withColumn("_own", F.struct(value.alias("v")))
    last = d.groupBy(*keys, "_bin").agg(F.max_by("_own", F.struct(*order)).alias("_last"))
    heads = last.select(*keys, "_bin", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bin")).alias("_before"))
    rows = d.withColumn("_own", F.lag("_own").over(Window.partitionBy(*keys, "_bin").orderBy(*order)))
    return rows.join(heads, [*keys, "_bin"]).select(*[c for c in df.columns if c != "previous"], F.coalesce("_own", "_before")["v"].alias("previous"))


def numbered(df: DataFrame, keys: list[str], time: str, width, ties: list = (), name: str = "i") -> DataFrame:
    """df with the rows of each key numbered from 0."""
    return running(df, keys, time, width, ties, **{name: ("count", F.lit(1))}).withColumn(name, F.col(name) - 1)


def quantiles(df: DataFrame, keys: list[str], value: str, parts: dict[str, float], bins: int = 1024) -> DataFrame:
    """Exact quantiles (linear between neighbours) of each key, by name: equal values are counted, and their running counts find the ranks."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    spread = counts.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_c").alias("_n"))
    d = counts.join(spread, keys)
    share = F.when(F.col("_high") > F.col("_low"), (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")))
    d = d.withColumn("_part", F.coalesce(F.floor(share * bins), F.lit(0).cast("bigint")))
    upto = running(d, keys, "_part", 1, ["_v"], _upto=("sum", F.col("_c")))
    found = []
    for name, p in parts.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            found.append(F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_v"))).alias(f"_{name}_{end}"))
    rows = upto.groupBy(*keys).agg(F.max("_n").alias("_n"), *found)

    def between(name: str, p: float) -> Column:
        at, low, high = (F.col("_n") - 1) * F.lit(float(p)), F.col(f"_{name}_low"), F.col(f"_{name}_high")
        return (low + (high - low) * (at - F.floor(at))).cast("double").alias(name)

    return rows.select(*keys, *[between(n, p) for n, p in parts.items()])


def _whole(kind: str, name: str, at: Column) -> Column:
    if kind == "last":
        return F.max_by(name, F.when(F.col(name).isNotNull(), at))
    return {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[kind](name)


def _over(kind: str, name: str, window) -> Column:
    if kind == "last":
        return F.last(name, ignorenulls=True).over(window)
    return {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[kind](name).over(window)


def _joined(kind: str, before: Column, own: Column) -> Column:
    if kind == "last":
        return F.coalesce(own, before)
    if kind in ("count", "sum"):
        return F.when(before.isNull() | own.isNull(), F.coalesce(own, before)).otherwise(own + before)
    return (F.least if kind == "min" else F.greatest)(own, before)
