"""Time-range export: requests, day plan, rows, missing channels, summary, frames."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewell.functions import timefmt
from samplewell.operators import calibrate, keys
from samplewell.sources import archive

REQUEST = "asset bigint, channels array<int>, start string, end string, format string, download_name string, box_id string"


def parse_request(df: DataFrame, text: str) -> DataFrame:
    """Adds status (`ok` or the first failed test), channels (sorted, distinct, comma-joined), start_ns, end_ns and file_name; the latter are null unless ok."""
    r = F.from_json(F.col(text), REQUEST)
    d = df.withColumn("r", r).withColumn("a", timefmt.parse_rfc3339(F.col("r.start"))).withColumn("b", timefmt.parse_rfc3339(F.col("r.end")))
    status = (
        F.when(F.col("r").isNull() | F.col("r.asset").isNull(), "bad request").when(F.coalesce(F.size("r.channels"), F.lit(0)) <= 0, "no channels").when(F.col("a").isNull(), "bad start").when(F.col("b").isNull(), "bad end")
        .when(F.col("b") < F.col("a"), "end before start").when(F.coalesce(F.col("r.format"), F.lit("csv")) != "csv", "format").otherwise("ok")
    )
    stamp = lambda c: F.date_format(F.timestamp_seconds(timefmt.whole_seconds(c).cast("bigint")), "yyyyMMdd'T'HHmmss")
    name = F.coalesce(F.col("r.download_name"), F.concat(F.lit("labjack_asset"), keys.padded_asset(F.col("r.asset")), F.lit("_"), stamp(F.col("a")), F.lit("_"), stamp(F.col("b")), F.lit(".csv")))
    ok = F.col("status") == "ok"
    d = d.withColumn("status", status)
    return d.select(
        *df.columns, "status", F.when(ok, F.array_join(F.transform(F.array_sort(F.array_distinct("r.channels")), lambda c: c.cast("string")), ",")).alias("channels"),
        F.when(ok, F.col("a")).alias("start_ns"), F.when(ok, F.col("b")).alias("end_ns"), F.when(ok, name).alias("file_name"),
    )


def day_plan(df: DataFrame, start_ns: Column, end_ns: Column) -> DataFrame:
    """One row per UTC day from start to end, both included."""
    return df.withColumn("day", F.explode(F.sequence(timefmt.utc_date(start_ns), timefmt.utc_date(end_ns))))


def export_rows(samples: DataFrame, dimension: DataFrame, asset: int, channels: list[int], start_ns: int, end_ns: int) -> DataFrame:
    """Calibrated rows of the channels in the range (both ends included), by channel and time. Raises for no channel and for end before start of a non-empty archive."""
    if not channels:
        raise ValueError("no channels requested")
    rows = archive.range_scan(archive.with_date(samples), asset, channels, start_ns, end_ns)
    out = calibrate.with_calibration(rows, dimension, ["channel"])
    return out.select("timestamp_unix_ns", "channel", F.col("value").alias("raw_value"), "calibrated_value", "calibration_id").orderBy("channel", "timestamp_unix_ns")


def requested(like: DataFrame, channels: list[int]) -> DataFrame:
    return like.sparkSession.createDataFrame([(c,) for c in sorted(set(channels))], "channel bigint")


def missing(rows: DataFrame, channels: list[int]) -> DataFrame:
    """Requested channels without a row."""
    return requested(rows, channels).join(rows.select("channel").distinct(), "channel", "left_anti")


def summary(rows: DataFrame, channels: list[int]) -> DataFrame:
    """Rows of each requested channel, and whether it has none."""
    n = rows.groupBy("channel").agg(F.count("*").alias("n"))
    return requested(rows, channels).join(n, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).alias("n_rows"), F.col("n").isNull().alias("missing"))


def frames(lines: DataFrame, line: str, order: list[str], missing_channels: list[int], chunk: int = 128 * 1024):
    """The frame protocol: meta, chunks of whole lines of at least `chunk` bytes (the last may be less), summary, complete; or an error, which ends it. Rows come from the executors one partition at a time."""
    yield {"type": "meta", "format": "csv"}
    held, size, total = [], 0, 0
    try:
        for r in lines.orderBy(*order).select(line).toLocalIterator(prefetchPartitions=True):
            data = (r[0] + "\n").encode()
            held.append(data)
            size += len(data)
            if size >= chunk:
                yield {"type": "chunk", "data": b"".join(held)}
                total, held, size = total + size, [], 0
    except Exception as e:  # the job failed: told in the protocol, as the receiver has had a part
        yield {"type": "error", "message": f"{type(e).__name__}: {e}"[:500]}
        return
    if held:
        yield {"type": "chunk", "data": b"".join(held)}
    yield {"type": "summary", "bytes": total + size, "missing": sorted(missing_channels)}
    yield {"type": "complete"}


def receive(incoming, idle: float = 30.0, clock=time.monotonic) -> tuple[bytes, dict]:
    """The client's side: (data, summary) of an iterator of frames. An error frame raises RuntimeError, as does an end before `complete` and a size that isn't the summary's; a pause of more than `idle` seconds raises TimeoutError.

    An iterator that has nothing yet may give None, so that the pause is seen.
    """
    parts, summary, last = [], None, clock()
    for f in incoming:
        if f is None:
            if clock() - last > idle:
                raise TimeoutError(f"no frame for {idle:g} s")
            continue
        last = clock()
        if f["type"] == "error":
            raise RuntimeError(f["message"])
        if f["type"] == "chunk":
            parts.append(f["data"])
        elif f["type"] == "summary":
            summary = f
        elif f["type"] == "complete":
            data = b"".join(parts)
            if summary is None or summary["bytes"] != len(data):
                raise RuntimeError("the export is not whole")
            return data, summary
    raise RuntimeError("the export ended before it was complete")


def csv_rows(rows: DataFrame) -> DataFrame:
    """Export rows as text columns: RFC 3339 time, chNN, shortest numbers."""
    return rows.select(
        timefmt.rfc3339(F.col("timestamp_unix_ns")).alias("timestamp"), keys.padded_channel(F.col("channel")).alias("channel"), timefmt.float_text(F.col("raw_value")).alias("raw_value"),
        timefmt.float_text(F.col("calibrated_value")).alias("calibrated_value"), "calibration_id",
    )


def write(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Export rows to CSV with a header (or to Parquet), in order of channel and time."""
    if kind == "parquet":
        rows.write.parquet(path)
    else:
        csv_rows(rows).write.option("header", "true").csv(path)
