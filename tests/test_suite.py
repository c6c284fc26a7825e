"""Suites over synthetic captures with a known lag, and messages from batches to text."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewell.operators import export, suite
from samplewell.sources import wire
from samplewell.streaming import messages


def _signal(spark, lag=0.0, gain=1.0, constant=False, start=0.0):
    rng = np.random.default_rng(4)
    t = np.arange(400) / 100 + start
    wave = np.interp(t - lag, np.arange(-50, 600) / 100, rng.normal(size=650).cumsum() / 5)
    v = np.ones_like(t) if constant else gain * wave
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, v)], "t double, v double")


def test_known_lag_and_gain(spark):
    m = suite.compare(_signal(spark), _signal(spark, lag=0.05))
    assert m["initial_lag_sec"] == pytest.approx(-0.05) and m["rmse"] < 1e-9 and m["pearson_correlation"] > 0.999 and abs(m["lag_sec_per_sec"]) < 1e-9
    assert suite.compare(_signal(spark), _signal(spark, gain=2.0))["mean_amplitude_ratio"] == pytest.approx(2.0)
    for bad in (_signal(spark, constant=True), _signal(spark, start=100.0)):
        with pytest.raises(ValueError):
            suite.compare(_signal(spark), bad)


def test_suite_isolates_errors(spark, tmp_path):
    config = {"defaults": {"thresholds": {"max_rmse": 0.25, "min_pearson_correlation": 0.8}}, "cases": [{"name": "good"}, {"name": "gain", "gain": 3.0}, {"name": "odd", "thresholds": {"max_nothing": 1}}, {"name": "gone", "missing": True}]}

    def load(case, side):
        if case.get("missing"):
            raise FileNotFoundError("no capture")
        return _signal(spark, gain=case.get("gain", 1.0) if side == "input" else 1.0)

    checks, report = suite.run(spark, json.dumps(config), load)
    got = {r["name"]: r for r in report.collect()}
    assert got["good"]["passed"] and got["gain"]["failed"] == "max_rmse" and "max_nothing" in got["odd"]["error"] and "no capture" in got["gone"]["error"] and checks.count() == 4
    suite.write_reports(checks, report, str(tmp_path))
    assert spark.read.option("header", "true").csv(f"{tmp_path}/report.csv").count() == 4


def test_batches_to_messages_to_text(spark, tmp_path):
    b = spark.createDataFrame([(0, 1000, 10, 1e8, [1.0, 2.0, 3.0, 4.0]), (1, 1020, 10, 1e8, [5.0, 6.0, 7.0]), (2, 1040, 10, 1e8, [])], "sequence bigint, first_sample_unix_ns bigint, sample_interval_ns bigint, actual_scan_rate_hz double, values array<double>")
    rows = messages.per_channel(b, [7, 11])
    assert {(r["channel"], tuple(r["values"])) for r in rows.collect()} == {(7, (1.0, 3.0)), (11, (2.0, 4.0))}
    out = messages.encoded(rows.withColumn("subject", F.concat(F.lit("a.ch"), F.col("channel").cast("string"))))
    assert {r["subject"]: wire.decode(bytes(r["payload"])) for r in out.collect()}["a.ch11"] == (1000, 10, 1e8, 0, [2.0, 4.0])
    out.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("subject string, payload binary").parquet(str(tmp_path / "in"))
    messages.publish(s, str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination(60)
    messages.append_text(spark.readStream.schema("subject string, payload binary").parquet(str(tmp_path / "log")), str(tmp_path / "text"), str(tmp_path / "c2")).awaitTermination(60)
    got = spark.read.option("header", "true").csv(str(tmp_path / "text"))
    assert got.count() == 4 and set(got.columns) == {"sequence", "timestamp", "raw_value", "channel"}


def test_export_file(spark, tmp_path):
    rows = spark.createDataFrame([(1776890700000075000, 11, 2.136379, 2.0, "identity")], "timestamp_unix_ns bigint, channel bigint, raw_value double, calibrated_value double, calibration_id string")
    export.write(rows.coalesce(1), str(tmp_path / "x"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "x")).collect()] == ["timestamp,channel,raw_value,calibrated_value,calibration_id", "2026-04-22T20:45:00.000075+00:00,ch11,2.136379,2,identity"]
