"""Running values over time bins against plain ones; exact times; ties; comparisons against numpy; streams against batches."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samplewell.functions import timefmt
from samplewell.operators import calibrate, config, display, export, keys, ordered, scans, series, suite, trigger
from samplewell.plans.queries import QUERIES
from samplewell.sources import archive, signals, wire
from samplewell.streaming import capture, sequence, trigger_state, windows

DAY = 86_400 * 10**9


def test_dates_and_times_to_the_nanosecond(spark):
    rng = random.Random(1)
    ns = [k * DAY + d for k in (-800, -1, 0, 19723, 40000) for d in (-1, 0, 1, -60, 119)] + [rng.randrange(-(2**63), 2**63) for _ in range(200)] + [-(2**63), 2**63 - 1]
    d = spark.createDataFrame([(x,) for x in ns], "ns bigint")
    epoch = np.datetime64("1970-01-01")
    for r in d.select("ns", timefmt.utc_date(F.col("ns")).cast("string").alias("day"), timefmt.rfc3339(F.col("ns")).alias("text")).withColumn("back", timefmt.parse_rfc3339(F.col("text"))).collect():
        assert r["day"] == str(epoch + np.timedelta64(r["ns"] // DAY, "D")) and r["back"] == r["ns"]


def test_times_that_bigint_cannot_hold_are_null(spark):
    texts = ["9999-12-31T23:59:59Z", "0001-01-01T00:00:00Z", "2262-04-11T23:47:16.854775807Z", "2262-04-11T23:47:16.854775808Z", "1677-09-21T00:12:43.145224192Z", "1677-09-21T00:12:43.145224191Z", "2024-02-30T00:00:00Z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(timefmt.parse_rfc3339(F.col("t"))).collect()]
    assert got == [None, None, 2**63 - 1, None, -(2**63), None, None]


def _rows(n=400, seed=3):
    rng = random.Random(seed)
    return [(rng.randrange(3), rng.randrange(0, 5000), i, rng.choice([None, float(rng.randrange(50))])) for i in range(n)]


def test_running_values_and_previous(spark):
    rows = _rows()
    d = spark.createDataFrame(rows, "k int, t bigint, o bigint, v double")
    got = ordered.running(d, ["k"], "t", 700, ["o"], n=("count", F.lit(1)), s=("sum", F.col("v")), low=("min", F.col("v")), high=("max", F.col("v")), last=("last", F.col("v")), next=("last", F.col("v"), "back"))
    got = {r["o"]: r for r in ordered.previous(got, ["k"], "t", 700, F.col("v"), ["o"]).collect()}
    assert len(got) == len(rows)
    for k in range(3):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        seen = []
        for j, r in enumerate(own):
            seen.append(r[3])
            known = [x for x in seen if x is not None]
            g = got[r[2]]
            assert (g["n"], g["s"], g["low"], g["high"], g["last"]) == ((j + 1, sum(known), min(known), max(known), known[-1]) if known else (j + 1, None, None, None, None))
            assert g["previous"] == (own[j - 1][3] if j else None)
        back = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        last = None
        for r in back:
            last = r[3] if r[3] is not None else last
            assert got[r[2]]["next"] == last


def test_exact_quantiles(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.random(), 0.5, 1e9])) for k in (1, 2) for _ in range(501 + k)] + [(3, 7.0), (4, None)]
    got = {r["k"]: r for r in ordered.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.99, "d": 0.0, "e": 1.0}, 16).collect()}
    assert set(got) == {1, 2, 3}
    for k in (1, 2, 3):
        v = [x for q, x in rows if q == k]
        assert [got[k][c] for c in "abcde"] == pytest.approx([float(np.percentile(v, p)) for p in (50, 95, 99, 0, 100)], rel=1e-12)


def test_ties_have_one_result(spark):
    c = spark.createDataFrame([(0, 0.0, 1.0, 1), (0, 1.0, 5.0, 2), (0, 1.0, 9.0, 3), (0, 2.0, 2.0, 4)], "k int, t double, v double, o int")
    p = spark.createDataFrame([(0, x) for x in (0.5, 1.0, 1.5, 2.5)], "k int, t double")
    for way in (c, c.orderBy(F.desc("o")), c.repartition(3)):
        assert [r[0] for r in series.interpolate(p, way, "k", order="o").orderBy("t").select("input_value").collect()] == [3.0, 5.0, 3.5, None]
    d = spark.createDataFrame([(0, 10, 0.0, 1), (0, 20, 3.0, 3), (0, 20, 0.0, 2), (0, 20, 5.0, 4), (0, 30, 0.0, 5)], "k int, t bigint, v double, o int")
    for way in (d, d.orderBy(F.desc("o")), d.repartition(3)):
        assert [(r["t"], r["v"]) for r in trigger.edges(way, "k", "t", "v", 2.0, order="o", width=7).collect()] == [(20, 3.0)]
        assert {(r["t"], r["v"]) for r in display.last_rows(way, "k", "t", 2, "o").collect()} == {(30, 0.0), (20, 5.0)}
        assert series.rate(way, "k", "t", 7).first()["dt"] == 10.0


def test_hold_off_by_batches(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(10_000)) for k in (1, 2, 3) for _ in range(300)]
    got = sorted(tuple(r) for r in trigger.held_off(spark.createDataFrame(rows, "k bigint, t bigint"), "k", "t", 57).collect())
    want = []
    for k in (1, 2, 3):
        last = None
        for t in sorted(t for q, t in rows if q == k):
            if last is None or t >= last + 57:
                want.append((k, t))
                last = t
    assert got == want


def test_window_lags_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(w, i, float(a), float(b)) for w in range(5) for i, (a, b) in enumerate(rng.normal(size=(8 + 7 * w, 2)))]
    got = {r["w"]: r["lag_samples"] for r in series.best_lag(spark.createDataFrame(rows, "w int, i bigint, x double, y double"), ["w"], "i", "x", "y", 100).collect()}
    for w in range(5):
        x, y = np.array([r[2:] for r in rows if r[0] == w]).T
        x, y = x - x.mean(), y - y.mean()
        c = {lag: round(float(sum(x[i] * y[i - lag] for i in range(len(x)) if 0 <= i - lag < len(y))), 6) for lag in range(1 - len(x), len(x))}
        assert got[w] == min(c, key=lambda k: (-c[k], k))


def plain_comparison(rt, rv, ct, cv):
    """The comparison of one pair in numpy."""
    (rt, i), (ct, j) = np.unique(rt, return_index=True), np.unique(ct, return_index=True)
    rv, cv = rv[i], cv[j]
    rates = [1 / np.median(np.diff(t)) for t in (rt, ct)]
    dt = 1 / min(rates)
    start, end = max(rt[0], ct[0]), min(rt[-1], ct[-1])
    grid = start + np.arange(int((end - start) // dt) + 1) * dt
    unit = lambda v: (v - v.mean()) / np.sqrt(((v - v.mean()) ** 2).mean())
    corr = lambda a, b: int(np.argmax(np.correlate(unit(a), unit(b), "full"))) - (len(b) - 1)
    lag = corr(np.interp(grid, rt, rv), np.interp(grid, ct, cv))
    s = ct + lag * dt
    ok = (rt >= max(rt[0], s[0])) & (rt <= min(rt[-1], s[-1]))
    t, r, c = rt[ok], rv[ok], np.interp(rt[ok], s, cv)
    e, size = c - r, min(len(t), max(8, int(round(0.5 * rates[0]))))
    starts = list(range(0, max(len(t) - size + 1, 1), max(1, size // 2)))
    starts += [len(t) - size] if starts[-1] != len(t) - size else []
    center = [t[a : a + size].mean() for a in starts]
    lags = [corr(r[a : a + size], c[a : a + size]) / rates[0] for a in starts]
    ratio = [c[a : a + size].std() / r[a : a + size].std() for a in starts]
    fit = lambda y: float(np.polyfit(center, y, 1)[0]) if len(y) > 1 else 0.0
    return {
        "grid_samples": len(grid), "lag_samples": lag, "n": len(t), "rmse": np.sqrt((e * e).mean()), "mae": np.abs(e).mean(), "max_abs_error": np.abs(e).max(), "abs_error_p95": np.percentile(np.abs(e), 95),
        "pearson_correlation": np.corrcoef(r, c)[0, 1], "mean_amplitude_ratio": np.mean(ratio), "lag_sec_per_sec": fit(lags), "amplitude_ratio_per_sec": fit(ratio),
    }


def test_validation_query_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["pair"]: r for r in QUERIES["validation_metrics"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 14).alias("ch"), (F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"), "value", "event_id").orderBy("us", "event_id").collect()
    first = min(r["us"] for r in rows)
    of = {k: np.array([((r["us"] - first) * 1000 / 1e9, r["value"]) for r in rows if r["ch"] == k]) for k in range(14)}
    assert set(got) == set(range(14))
    for k in range(14):
        want = plain_comparison(*of[k].T, *of[(k + 1) % 14].T)
        assert got[k]["error"] is None
        for name, x in want.items():
            assert got[k][name] == pytest.approx(x, rel=1e-5, abs=2e-6), (k, name)


def test_files_of_a_suite(spark, tmp_path):
    """Recorder text against exported CSV and archived Parquet, end to end; a missing file and an unknown channel are their case's errors."""
    rng = np.random.default_rng(3)
    t = np.arange(300) / 100
    wave = rng.normal(size=300).cumsum() / 3
    (tmp_path / "ref.dat").write_text("recorder 7\ntime,a,b\n" + "\n".join(f"{a:.2f},{v!r},{-v!r}" for a, v in zip(t.tolist(), wave.tolist())))
    base = 1_776_890_700_000_000_000
    ns = [base + int(round(a * 1e9)) for a in t]
    rows = spark.createDataFrame([(1, 1, n, float(v)) for n, v in zip(ns, wave)], "asset bigint, channel bigint, timestamp_unix_ns bigint, value double")
    out = export.csv_rows(rows.select("timestamp_unix_ns", "channel", F.col("value").alias("raw_value"), (F.col("value") * 3).alias("calibrated_value"), F.lit("x").alias("calibration_id")))
    out.coalesce(1).write.option("header", "true").csv(str(tmp_path / "in.csv"))
    rows.select("timestamp_unix_ns", "value").coalesce(1).write.parquet(str(tmp_path / "day"))
    cases = [{"name": "csv", "input": "in.csv"}, {"name": "gain", "input": "in.csv", "signal_column": "calibrated_value"}, {"input": "day", "input_format": "parquet"}, {"name": "gone", "input": "no.csv"}, {"name": "channel", "reference_channel": 9, "input": "in.csv"}]
    suite_json = json.dumps({"defaults": {"reference": "ref.dat", "reference_channel": 1, "thresholds": {"max_rmse": 1e-6, "max_abs_initial_lag_sec": 0.001}}, "cases": cases})
    checks, report = suite.run(spark, suite_json, signals.of_case(spark, str(tmp_path)))
    got = {r["name"]: r for r in report.collect()}
    # channel 1 of the recorder is the wave with its sign turned
    assert got["csv"]["failed"] and got["gone"]["error"] and "channel 9" in got["channel"]["error"]
    suite_json = suite_json.replace('"reference_channel": 1,', '"reference_channel": 0,')
    (tmp_path / "in.csv").rename(tmp_path / "old.csv")
    out.withColumn("channel", F.lit("ch00")).coalesce(1).write.option("header", "true").csv(str(tmp_path / "in.csv"))
    checks, report = suite.run(spark, suite_json, signals.of_case(spark, str(tmp_path)))
    got = {r["name"]: r for r in report.collect()}
    assert got["csv"]["passed"] and got["case_03"]["passed"] and got["gain"]["failed"] == "max_rmse" and checks.count() == 6


def test_comparison_files(spark, tmp_path):
    d = spark.createDataFrame([(k, i / 10, float(np.sin(i / 3 + k))) for k in (1, 2) for i in range(60)], "k bigint, t double, v double")
    pairs, samples = suite.align(d, d, "k")
    suite.write_comparison(suite.metrics(pairs, samples, "k"), samples, "k", str(tmp_path))
    back = spark.read.option("header", "true").csv(str(tmp_path / "aligned_samples"))
    assert back.count() == 120 and {"time_sec", "error", "relative_error", "k"} <= set(back.columns)
    assert {r["lag_samples"] for r in spark.read.json(str(tmp_path / "summary.json")).collect()} == {0}


def test_calibration_travels_with_the_archive(spark, tmp_path):
    s = spark.createDataFrame([(1, 2, k * 10, float(k)) for k in range(10)] + [(1, 3, 5, 1.0)], "asset bigint, channel bigint, timestamp_unix_ns bigint, value double")
    spec = f"spec struct<{', '.join(p.replace(' ', ':') for p in calibrate.SPEC.split(', '))}>"
    when = spark.createDataFrame([(2, 0, 50, ("a", "linear", 2.0, 0.0, None)), (2, 50, None, ("b", "linear", 3.0, 0.0, None))], f"channel bigint, effective_from_ns bigint, effective_to_ns bigint, {spec}")
    archive.write_calibrated(s, when, str(tmp_path / "a"))
    got = {(r["channel"], r["timestamp_unix_ns"]): (r["calibrated_value"], r["calibration_id"]) for r in archive.calibrated(archive.read(spark, str(tmp_path / "a"))).collect()}
    assert got == {**{(2, k * 10): (k * (2.0 if k < 5 else 3.0), "a" if k < 5 else "b") for k in range(10)}, (3, 5): (1.0, "identity")}
    files = archive.read(spark, str(tmp_path / "a")).groupBy(F.input_file_name().alias("f")).agg(F.count_distinct("calibration").alias("n")).collect()
    assert all(r["n"] == 1 for r in files)


def test_broken_files_are_skipped(spark, tmp_path):
    s = spark.createDataFrame([(1, 2, 10, 1.0)], "asset bigint, channel bigint, timestamp_unix_ns bigint, value double")
    archive.write(s, str(tmp_path / "a"))
    part = next((tmp_path / "a").rglob("part-*.parquet")).parent
    (part / "part-99.parquet").write_bytes(b"PAR1 no such file")
    assert archive.read(spark, str(tmp_path / "a")).schema and archive.read(spark, str(tmp_path / "a")).count() == 1


def test_raw_values_that_are_not_finite(spark):
    d = spark.createDataFrame([(x,) for x in (float("inf"), float("-inf"), float("nan"), 2.0, None)], "x double")
    spec = F.struct(F.lit("p").alias("id"), F.lit("polynomial").alias("type"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0)).alias("coeffs"))
    got = [r[0] for r in d.select(calibrate.apply(F.col("x"), spec)).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and np.isnan(got[2]) and got[3] == 9.0 and got[4] is None


def test_frames_and_their_receiver(spark):
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(100)], "i int, line string").repartition(3)
    data, summary = export.receive(export.frames(lines, "line", ["i"], [7], chunk=200))
    assert data.decode().splitlines() == [f"line {i}" for i in range(100)] and summary["missing"] == [7]
    bad = lines.withColumn("line", F.when(F.col("i") == 50, F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(RuntimeError, match="broken"):
        export.receive(export.frames(bad, "line", ["i"], []))
    with pytest.raises(RuntimeError, match="before"):
        export.receive(iter([{"type": "meta", "format": "csv"}]))
    ticks = iter(range(0, 1000, 20))
    with pytest.raises(TimeoutError):
        export.receive(iter([{"type": "meta"}, None, None, None]), clock=lambda: next(ticks))


def test_keys_and_configurations(spark):
    one = lambda *c: spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first()
    assert list(one(*keys.export_subjects(F.lit("plant.export."), F.lit(" Box 1 "), F.lit("job/7")))) == ["plant.export.request.box-1", "plant.export.reply.job-7"]
    got = one(*[config.parse_channels(F.lit(t)) for t in ("3, ,1,", "1,-2", "1,x", " , ")])
    assert [None if x is None else list(x) for x in got] == [[3, 1], None, None, None]
    channels, units = F.array(F.lit(7), F.lit(2)), F.array(F.lit("V"), F.lit("N"))
    got = one(config.zipped(channels, unit=units), *[config.toggled(channels, F.lit(c), unit=(units, F.lit("kg"))) for c in (2, 5)])
    assert [[tuple(p) for p in x] for x in got] == [[(2, "N"), (7, "V")], [(7, "V")], [(2, "N"), (5, "kg"), (7, "V")]]
    log = spark.createDataFrame([("a", 1, "PUT", 10), ("a", 2, "PUT", 20), ("a", 3, "DEL", None), ("a", 4, "PUT", 21), ("a", 5, "PUT", 21)], "key string, revision int, op string, v int")
    runs = config.with_runs(log, [F.col("v") % 10], [F.col("v")]).orderBy("revision").collect()
    assert [(r["kind"], r["run_id"]) for r in runs] == [("added", 0), ("recalibrate", 0), ("respawn", 1), ("none", 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.floats(-2, 2)), min_size=1, max_size=60), st.integers(0, 6), st.integers(0, 9), st.booleans(), st.booleans(), st.integers(1, 59))
def test_trigger_machine_in_pieces(steps, pre, post, rising, single, cut):
    """Crossings by numpy, whole or cut into batches, against a plain loop."""
    times, t = [], 0
    for s, _ in steps:
        t += s
        times.append(t)
    values = [v for _, v in steps]
    want, first, last, trigger_at = [], times[0], None, None
    for t, v in zip(times, values):
        crossed = last is not None and (last <= 0.5 < v if rising else last >= 0.5 > v)
        if crossed and t - first >= pre and (trigger_at is None or not single and t >= trigger_at + post):
            trigger_at = t
            want.append((t, v))
        last = v
    state, got = (None, None, 0, None), []
    for a, b in ((0, cut), (cut, len(times))):
        state, found = trigger_state.step(state, times[a:b], values[a:b], 0.5, rising, pre, post, single)
        got += found
    assert got == want


def test_lists_of_messages_with_absent_vectors(spark):
    rows = [(wire.encode(1, 2, 3.0, 4, [1.0, 2.0]),), (None,), (wire.encode(5, 6, 7.0, 8, []),)]
    got = wire.decode_messages(spark.createDataFrame(rows, "payload binary")).collect()
    assert [r["values"] for r in got] == [[1.0, 2.0], []]
    assert wire._lists([None, np.array([1.0]), None]).to_pylist() == [None, [1.0], None]


def _stream(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _taken(out, tmp_path, name, mode="append"):
    out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start().awaitTermination(120)
    return out.sparkSession.table(name).collect()


def test_sequence_states_over_batches(spark, tmp_path):
    rows = [(1, 0, a, s) for a, s in enumerate([5, 6, 9, 9, 3, 4])] + [(1, 1, 6, 0), (2, 0, 7, 1)]
    got = _taken(sequence.continuity(_stream(spark, tmp_path, [rows[:3], rows[3:]], "channel bigint, run_id bigint, arrival bigint, sequence bigint")), tmp_path, "seq")
    assert sorted((r["channel"], r["run_id"], r["sequence"], r["state"], r["missing"]) for r in got) == sorted([(1, 0, 5, "first", 0), (1, 0, 6, "ok", 0), (1, 0, 9, "gap", 2), (1, 0, 9, "reset", 0), (1, 0, 3, "reset", 0), (1, 0, 4, "ok", 0), (1, 1, 0, "first", 0), (2, 0, 1, "first", 0)])


def test_captures_over_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(1, 10 * i, float(rng.choice([0, 1]))) for i in range(120)]
    schema = "channel bigint, timestamp_unix_ns bigint, value double"
    got = _taken(capture.captures(_stream(spark, tmp_path, [rows[:31], rows[31:33], rows[33:90], rows[90:]], schema), 0.5, pre=40, post=75), tmp_path, "cap")
    _, found = trigger_state.step((None, None, 0, None), [r[1] for r in rows], [r[2] for r in rows], 0.5, True, 40, 75, False)
    want = sorted((t, x, v) for t, _ in found for _, x, v in rows if t - 40 <= x <= t + 75)
    assert sorted((r["trigger_ns"], r["timestamp_unix_ns"], r["value"]) for r in got) == want and len(found) > 3


def test_late_samples_and_sessions(spark, tmp_path):
    s = 10**9
    rows = [[(1, 0 * s, 1.0), (1, 1 * s, 3.0), (1, 20 * s, 5.0)], [(1, 2 * s, 9.0), (1, 100 * s, 1.0)], [(1, 200 * s, 1.0)], [(1, 3 * s, 7.0), (1, 300 * s, 1.0)]]
    schema = "channel bigint, timestamp_unix_ns bigint, value double"
    got = _taken(windows.sessions(_stream(spark, tmp_path, rows, schema), "5 seconds", "30 seconds"), tmp_path, "sess")
    assert sorted((r["start"].timestamp(), r["n"], r["high"]) for r in got) == [(0.0, 3, 9.0), (20.0, 1, 5.0), (100.0, 1, 1.0), (200.0, 1, 1.0)]  # the sample of 3 s comes after the watermark has passed it
    got = windows.windowed(spark.createDataFrame(sum(rows, []), schema), "10 seconds", "0 seconds", "5 seconds").where("n > 1").collect()
    assert {(r["start"].timestamp(), r["n"]) for r in got} == {(0.0, 4), (-5.0, 4)}


def test_clock_and_sequence_in_bins(spark):
    rows = [(r, a, 3 + a % 4) for r in (1, 2) for a in range(0, 300, 1 + r)]
    d = scans.stream_clock(spark.createDataFrame(rows, "run int, a bigint, n int"), "run", "a", F.col("n"), F.lit(10), F.lit(1000), 40)
    for run in (1, 2):
        at = 1000
        for k, r in enumerate(d.where(F.col("run") == run).orderBy("a").collect()):
            assert (r["sequence"], r["first_sample_unix_ns"]) == (k, at)
            at += 10 * r["n"]


def test_box_configurations(spark):
    box = {
        "site_id": "s", "box_id": "b 1", "source": {"type": "t", "id": 'i"7'}, "nats": {"root_subject": "plant", "stream_name": "st", "leaf_remotes": ["x://a:7422", " ", "x://b:1"], "local_servers": "l"},
        "labjack": {"name": "n", "asset_number": 7, "max_channels": 8, "rotate_secs": 300, "serial": 4, "sensor_settings": {"scans_per_read": 5, "channels_enabled": [1, 2]}}, "paths": {"parquet_dir": "/p"},
    }
    text = F.lit(json.dumps(box))
    other = F.lit(json.dumps({"nats": {"central_servers": ["a", " b "], "leaf_remotes": ["c:7422"]}}))
    r = spark.range(1).select(config.device_of_box(text).alias("d"), config.environment(text).alias("e"), config.environment(text, config.ARCHIVER).alias("a"), config.central_servers(text).alias("c"), config.central_servers(other).alias("o")).first()
    assert json.loads(r["d"]) == {
        "labjack_name": "n", "asset_number": 7, "max_channels": 8, "site_id": "s", "box_id": "b 1", "source_type": "t", "source_id": 'i"7', "nats_subject": "plant", "nats_stream": "st", "rotate_secs": 300,
        "sensor_settings": {"scans_per_read": 5, "channels_enabled": [1, 2]},
    }
    assert r["e"]["LABJACK_USB_ID"] == "ANY" and r["e"]["ASSET_NUMBER"] == "7" and "STREAM_MAX_BYTES" not in r["e"] and r["a"]["PARQUET_DIR"] == "/p" and (r["c"], r["o"]) == ("x://a:4222,x://b:1", "a,b")


def test_servers_and_subjects(spark):
    d = spark.createDataFrame([(" host:8080/ ",), ("http://h/",), ("wss://h/x",), (" ",)], "t string")
    assert [list(r[0]) for r in d.select(keys.websocket_servers(F.col("t"))).collect()] == [["ws://host:8080", "wss://host:8080"], ["ws://h"], ["wss://h/x"], []]
    d = spark.createDataFrame([(x,) for x in ("a.v1.b.ch01", "a.v1.b.c.ch01", "a.v1", "a$v1.b")], "s string")
    fits = lambda p: [r[0] for r in d.select(keys.matches(F.col("s"), p)).collect()]
    assert fits("a.v1.*.*") == [True, False, False, False] and fits("a.v1.>") == [True, True, False, False] and fits("a$v1.*") == [False, False, False, True]


def test_a_failed_stream_is_started_again(spark, tmp_path):
    from samplewell.streaming import messages

    spark.createDataFrame([("a.ch1", b"1"), ("b.ch1", b"2")], "subject string, payload binary").write.parquet(str(tmp_path / "log"))
    tries, waits = [], []

    def start():
        tries.append(1)
        s = messages.subscribe(spark, str(tmp_path / "log"), "a.*")
        s = s.withColumn("payload", F.raise_error(F.lit("lost"))) if len(tries) < 3 else s
        return messages.publish(s.select("subject", "payload"), str(tmp_path / "out"), str(tmp_path / "c"))

    messages.supervised(start, lambda: len(tries) > 5, 1.5, waits.append)
    assert len(tries) == 3 and waits == [1.5, 1.5] and [r["subject"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a.ch1"]
