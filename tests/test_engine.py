"""Facts, round trips, properties, and streams against batches."""

import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samplewell.functions import timefmt, xcorr
from samplewell.operators import calibrate, display, export, keys, scans, series, trigger
from samplewell.sources import archive, kv, wire
from samplewell.streaming import archive_stream, latest, trigger_state


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_interval_clock_and_reset(spark):
    r = one(spark, scans.sample_interval_ns(F.lit(5000.0)), scans.sample_interval_ns(F.lit(0.0)), scans.sample_interval_ns(F.lit(math.inf)))
    assert tuple(r) == (200000, None, None)
    d = spark.createDataFrame([("r", 0, 10), ("r", 1, 0), ("r", 2, 10), ("s", 3, 10)], "run string, o int, n int")
    got = scans.stream_clock(d, "run", "o", F.col("n"), F.lit(200000), F.lit(7)).orderBy("o").select("sequence", "first_sample_unix_ns").collect()
    assert [tuple(x) for x in got] == [(0, 7), (1, 2000007), (0, 7)]


def test_subjects_and_addresses(spark):
    s = lambda a, b, c, d, e, f: keys.channel_subject(F.lit(a), F.lit(b), F.lit(c), F.lit(d).cast("string"), F.lit(e).cast("string"), F.lit(f))
    assert one(spark, s("plantbox", 1456, 11, None, None, "x"))[0] == "plantbox.1456.data.ch11"
    assert one(spark, s("plant", 1456, 11, "i69-mu1", None, "i69-lj2"))[0] == "plant.v1.i69-mu1.i69-lj2.ch11"
    assert one(spark, keys.ipv4(F.lit(-1062731418)), keys.ipv4(F.lit(0)))[:] == ("192.168.1.102", None)
    assert one(spark, keys.sanitize(F.lit(" A..b/c é")), keys.sanitize(F.lit("--")), keys.sanitize(F.lit("Load Cell.A")))[:] == ("a--b-c", "unknown", "load-cell-a")


def test_time_text(spark):
    ns = [0, 1776890700000075000, 1776890700000000001, 1776890700120000000, -1]
    d = spark.createDataFrame([(n,) for n in ns], "ns bigint").select("ns", timefmt.rfc3339(F.col("ns")).alias("s")).withColumn("back", timefmt.parse_rfc3339(F.col("s")))
    got = {r["ns"]: r for r in d.collect()}
    assert got[1776890700000075000]["s"] == "2026-04-22T20:45:00.000075+00:00" and got[0]["s"] == "1970-01-01T00:00:00+00:00" and all(r["back"] == n for n, r in got.items())
    assert one(spark, timefmt.parse_rfc3339(F.lit("yesterday")), timefmt.parse_rfc3339(F.lit("2025-10-24T08:30:00-04:00")))[:] == (None, 1761309000000000000)


def test_float_text(spark):
    x = [2.0, -0.5, 1e10, 1.25e-7, 123456789.125, 0.0, 1.5e300, math.nan, math.inf]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(timefmt.float_text(F.col("x"))).collect()]
    assert got[:7] == ["2", "-0.5", "10000000000", "0.000000125", "123456789.125", "0", "15" + "0" * 299] and got[7:] == ["NaN", "inf"]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**62), st.integers(0, 2**40), st.floats(0, 1e6), st.integers(0, 2**62), st.lists(st.floats(allow_nan=False)))
def test_wire_round_trip(first, interval, rate, sequence, values):
    assert wire.decode(wire.encode(first, interval, rate, sequence, values)) == (first, interval, rate, sequence, values)


def test_wire_rejects():
    good = wire.encode(1, 2, 3.0, 4, [5.0, 6.0])
    assert wire.decode(None) is None and wire.decode(b"") is None and wire.decode(b"\x01\x02") is None and wire.decode(good[:-3]) is None
    assert wire.decode(wire.encode(0, 2, 3.0, 4, [])[:20] + b"\xff" * 40) is None
    assert struct.unpack_from("<I", good)[0] == 20


def test_wire_agrees_with_the_flatbuffers_package():
    flatbuffers = pytest.importorskip("flatbuffers")
    b = flatbuffers.Builder(0)
    b.StartVector(8, 2, 8)
    for v in (6.0, 5.0):
        b.PrependFloat64(v)
    vec = b.EndVector()
    b.StartObject(5)
    b.PrependUOffsetTRelativeSlot(4, vec, 0)
    b.PrependUint64Slot(3, 9, 0)
    b.PrependFloat64Slot(2, 5000.0, 0.0)
    b.PrependUint64Slot(0, 123, 0)
    b.Finish(b.EndObject())
    assert wire.decode(bytes(b.Output())) == (123, 0, 5000.0, 9, [5.0, 6.0])


def test_old_layout_and_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    d = tmp_path / "asset001/2026-04-22/ch11"
    d.mkdir(parents=True)
    t = pa.table({"timestamp_unix_ns": [1, 2], "value": [0.5, 1.5]})
    pq.write_table(t.replace_schema_metadata({"calibration": '{"type":"linear","a":2,"b":1}'}), d / "part-0000.parquet")
    pq.write_table(t, d / "part-0001.parquet")
    (d / "part-0002.parquet").write_bytes(b"broken")
    got = archive.read_old_layout(spark, str(tmp_path), 1, [11, 12], ["2026-04-22", "2026-04-23"])
    assert got.count() == 4 and got.select("asset", "channel").distinct().collect()[0][:] == (1, 11) and str(got.first()["date"]) == "2026-04-22"
    specs = archive.footer_calibrations(spark, [str(d / f"part-000{k}.parquet") for k in range(3)]).collect()
    assert ['"a":2' in r["spec"] for r in specs] == [True, False, False] and "identity" in specs[1]["spec"]
    assert archive.read_old_layout(spark, str(tmp_path), 2, [11], ["2026-04-22"]).count() == 0


def test_range_scan_prunes_and_pushes(spark, tmp_path):
    s = spark.range(2000).select(F.lit(1).alias("asset"), (F.col("id") % 4).alias("channel"), (F.col("id") * 86_400_000_000).alias("timestamp_unix_ns"), F.col("id").cast("double").alias("value"))
    archive.write(s, str(tmp_path / "a"))
    q = archive.range_scan(archive.read(spark, str(tmp_path / "a")), 1, [0, 2], 0, 86_400_000_000_000)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(asset" in plan and "GreaterThanOrEqual(timestamp_unix_ns" in plan and q.count() == 501


def test_export_frames(spark):
    d = spark.createDataFrame([(2, "b" * 60), (1, "a" * 60), (3, "c")], "k int, line string")
    f = list(export.frames(d, "line", ["k"], [7], chunk=100))
    assert [x["type"] for x in f] == ["meta", "chunk", "chunk", "summary", "complete"] and f[1]["data"].startswith(b"a") and f[3] == {"type": "summary", "bytes": 124, "missing": [7]}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=200))
def test_downsampling_keeps_extremes(spark, values):
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "c int, t int, v double")
    got = [r["v"] for r in display.downsample_minmax(d, "c", "t", "v", 16).collect()]
    assert min(got) == min(values) and max(got) == max(values) and len(got) <= max(32, 2 * 16)


def test_interleaving_is_undone(spark):
    d = spark.createDataFrame([(0, 3, [float(x) for x in range(12)])], "b int, n int, values array<double>")
    got = scans.deinterleave(d, "values", "n")
    assert all(r["value"] == r["scan_index"] * 3 + r["channel_index"] for r in got.collect()) and got.count() == 12


def test_polynomial_forms_agree(spark):
    c = [0.5, -1.0, 2.0]
    a, b = one(spark, calibrate.polynomial(F.lit(3.0), F.array(*map(F.lit, c))), calibrate.polynomial_of(F.lit(3.0), c))
    assert a == b == 15.5


def test_lag_metrics_and_checks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    assert xcorr.best_lag(x[20:280], x[15:275]) == -5 and xcorr.best_lag(np.ones(9), x[:9]) is None and xcorr.best_lag(x[:0], x) is None
    d = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 2.0)], "k int, reference_value double, input_value double")
    m = series.summary(d, "k")
    got = series.checks(m, "k", [("min_pearson_correlation", 0.8), ("max_mae", 0.5)]).orderBy("nth").collect()
    assert math.isnan(got[0]["value"]) and [r["passed"] for r in got] == [False, True] and series.report(series.checks(m, "k", [("min_pearson_correlation", 0.8)]), "k").first()["failed"] == "min_pearson_correlation"
    with pytest.raises(ValueError):
        series.checks(m, "k", [("max_nothing", 1.0)])


def _trace(spark):
    rows = [(c, 1000 * i, 100 * math.sin(i / 7 + c) + (i * 37 % 11)) for c in range(3) for i in range(300)]
    return rows, spark.createDataFrame(rows, "channel bigint, timestamp_unix_ns bigint, value double")


def test_hold_off(spark):
    _, d = _trace(spark)
    e = trigger.edges(d, "channel", "timestamp_unix_ns", "value", 50.0)
    got = sorted(map(tuple, trigger.held_off(e, "channel", "timestamp_unix_ns", 60_000).collect()))
    want = []
    for c in range(3):
        last = None
        for (t,) in e.where(F.col("channel") == c).orderBy("timestamp_unix_ns").select("timestamp_unix_ns").collect():
            if last is None or t >= last + 60_000:
                last = t
                want.append((c, t))
    assert got == want


def test_trigger_stream_equals_batch(spark, tmp_path):
    rows, d = _trace(spark)
    for k in range(3):  # three batches, in order of time
        d.where(F.col("timestamp_unix_ns").between(100_000 * k, 100_000 * (k + 1) - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("channel bigint, timestamp_unix_ns bigint, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = trigger_state.triggers(s, 50.0, pre=20_000, post=60_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = []
    for c in range(3):
        own = [(t, v) for k, t, v in rows if k == c]
        want += [(c, t) for t, _ in trigger_state.step((None, None, 0, None), [t for t, _ in own], [v for _, v in own], 50.0, True, 20_000, 60_000, False)[1]]
    assert sorted((r["channel"], r["trigger_ns"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want and want


def test_archive_stream_and_conflation(spark, tmp_path):
    rows = [(1, c, wire.encode(86_400_000_000_000 - 500 + c, 100, 1e7, b, [float(b), 1.0] * 8)) for c in range(2) for b in range(3)] + [(1, 0, b"bad")]
    spark.createDataFrame(rows, "asset bigint, channel bigint, payload binary").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("asset bigint, channel bigint, payload binary").parquet(str(tmp_path / "in"))
    archive_stream.start(s, str(tmp_path / "a"), str(tmp_path / "c")).awaitTermination(120)
    got = archive.read(spark, str(tmp_path / "a"))
    batch = archive_stream.samples(spark.read.parquet(str(tmp_path / "in")))
    assert got.count() == batch.count() == 96 and got.select("date").distinct().count() == 2
    seen = []
    s = spark.readStream.schema("asset bigint, channel bigint, payload binary").parquet(str(tmp_path / "in"))
    latest.conflate(s.withColumn("n", F.length("payload")), "channel", "n", lambda d, n: seen.append(d.count()), str(tmp_path / "c2")).awaitTermination(120)
    assert sum(seen) == 2


def test_key_value_log(spark, tmp_path):
    from samplewell.operators import config

    kv.put(spark, str(tmp_path / "kv"), [("v1.a.b.config", 1, "x"), ("v1.a.b.config", 2, "y"), ("calibration.z", 3, "c"), ("v1.q.r.config", 4, "n"), ("v1.q.r.config", 5, None)])
    log = kv.read(spark, str(tmp_path / "kv"))
    assert [tuple(r) for r in kv.matching(config.latest(log), "v1.*.*.config").select("key", "value").collect()] == [("v1.a.b.config", "y")]
    rows = []
    latest.with_latest_config(kv.watch(spark, str(tmp_path / "kv")).select("key"), lambda: kv.read(spark, str(tmp_path / "kv")), "key", lambda d, n: rows.extend(d.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert len(rows) == 4
