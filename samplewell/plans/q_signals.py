"""Queries over pairs of signals, triggers and live views."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewell.operators import display, ordered, series, suite, trigger
from samplewell.operators.scans import finite
from samplewell.plans.registry import query, samples, table

_HOUR = 3_600_000_000_000
_DAY = 24 * _HOUR  # events lie hours apart: bins of a day
_AL = """WITH @samples, m AS (SELECT min(timestamp_unix_ns) m FROM samples), s AS (SELECT channel, (timestamp_unix_ns - m)::DOUBLE / 1e9 t, value v, event_id FROM samples, m),
u AS (SELECT channel p, t, event_id, v AS r, NULL::DOUBLE ct, NULL::DOUBLE cv, true pt, NULL ce FROM s UNION ALL SELECT (channel + 13) % 14, t, NULL, NULL, t, v, false, event_id FROM s),
w AS (SELECT *, last_value(ct IGNORE NULLS) OVER f lt, last_value(cv IGNORE NULLS) OVER f lv, last_value(ct IGNORE NULLS) OVER b rt, last_value(cv IGNORE NULLS) OVER b rv FROM u
WINDOW f AS (PARTITION BY p ORDER BY t, pt, ce DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY p ORDER BY t DESC, pt, ce DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
al AS (SELECT p pair, t, event_id, r, CASE WHEN lt = t THEN lv WHEN rt = t THEN rv ELSE lv + (rv - lv) * (t - lt) / (rt - lt) END i FROM w WHERE pt),
ok AS (SELECT *, i - r e, abs(i - r) a, abs(i - r) / greatest(abs(r), 2.220446049250313e-16) rel FROM al WHERE i IS NOT NULL) """
_N = "CAST(count(*) AS BIGINT)"


def _seconds(spark, sf):
    """Samples with t, in seconds since the first of all."""
    s = samples(spark, sf)
    first = s.agg(F.min("timestamp_unix_ns").alias("m"))
    return s.join(F.broadcast(first)).withColumn("t", (F.col("timestamp_unix_ns") - F.col("m")).cast("double") / 1e9).drop("m")


def _aligned(spark, sf):
    """Channel p as the reference of pair p, channel p + 1 as its candidate."""
    s = _seconds(spark, sf)
    points = s.select(F.col("channel").alias("pair"), "t", "event_id", F.col("value").alias("reference_value"))
    candidate = s.select(F.pmod(F.col("channel") + 13, F.lit(14)).alias("pair"), "t", F.col("value").alias("v"), "event_id")
    return series.interpolate(points, candidate, "pair", order="event_id")


def _pairs(spark, sf):
    return _aligned(spark, sf).where("input_value is not null")


def _r(c, n=6):
    return F.round(c, n).alias(c)


@query("interp_join", _AL + "SELECT pair, event_id, round(r, 6) reference_value, round(i, 6) input_value FROM al")
def interp_join(spark, sf):
    return _aligned(spark, sf).select("pair", "event_id", _r("reference_value"), _r("input_value"))


@query("aligned_samples", _AL + "SELECT pair, event_id, round(t, 6) t, round(r, 6) reference_value, round(i, 6) input_value, round(e, 6) error FROM ok")
def aligned_samples(spark, sf):
    return _pairs(spark, sf).select("pair", "event_id", _r("t"), _r("reference_value"), _r("input_value"), F.round(F.col("input_value") - F.col("reference_value"), 6).alias("error"))


@query("relative_errors", _AL + "SELECT pair, event_id, round(a, 6) abs_error, round(rel, 4) relative_error FROM ok")
def relative_errors(spark, sf):
    e = F.col("input_value") - F.col("reference_value")
    return _pairs(spark, sf).select("pair", "event_id", F.round(F.abs(e), 6).alias("abs_error"), F.round(series.relative_error(e, F.col("reference_value")), 4).alias("relative_error"))


_METRICS = ("rmse", "mae", "max_abs_error", "mean_error", "std_error", "min_error", "max_error")


@query("error_metrics", _AL + f"SELECT pair, {_N} n, round(sqrt(avg(e*e)), 6) rmse, round(avg(a), 6) mae, round(max(a), 6) max_abs_error, round(avg(e), 6) mean_error, round(stddev_pop(e), 6) std_error, round(min(e), 6) min_error, round(max(e), 6) max_error FROM ok GROUP BY pair")
def error_metrics(spark, sf):
    return series.summary(_pairs(spark, sf), "pair").select("pair", "n", *map(_r, _METRICS))


@query("error_percentiles", _AL + "SELECT pair, round(quantile_cont(a, .5), 6) abs_error_p50, round(quantile_cont(a, .95), 6) abs_error_p95, round(quantile_cont(a, .99), 6) abs_error_p99 FROM ok GROUP BY pair")
def error_percentiles(spark, sf):
    return series.summary(_pairs(spark, sf), "pair").select("pair", *[_r(f"abs_error_p{p}") for p in (50, 95, 99)])


@query("pearson", _AL + "SELECT pair, round(corr(r, i), 6) r FROM ok GROUP BY pair")
def pearson(spark, sf):
    return _pairs(spark, sf).groupBy("pair").agg(F.round(series.pearson("reference_value", "input_value"), 6).alias("r"))


@query("sample_rate_estimate", "WITH @samples, d AS (SELECT channel, (timestamp_unix_ns - lag(timestamp_unix_ns) OVER (PARTITION BY channel ORDER BY timestamp_unix_ns, event_id)) / 1e9 d FROM samples) SELECT channel, round(quantile_cont(d, .5), 6) dt, round(1 / quantile_cont(d, .5), 9) rate FROM d WHERE d > 0 GROUP BY channel")
def sample_rate_estimate(spark, sf):
    d = series.rate(samples(spark, sf), "channel", "timestamp_unix_ns", _DAY)
    return d.select("channel", F.round(F.col("dt") / 1e9, 6).alias("dt"), F.round(1e9 / F.col("dt"), 9).alias("rate"))


@query("signal_overlap", "WITH @samples, x AS (SELECT channel, count(*) n, min(timestamp_unix_ns) a, max(timestamp_unix_ns) b FROM samples GROUP BY channel) SELECT r.channel pair, r.n, c.n m, greatest(r.a, c.a) start_ns, least(r.b, c.b) end_ns FROM x r JOIN x c ON c.channel = (r.channel + 1) % 14")
def signal_overlap(spark, sf):
    s = samples(spark, sf).select(F.col("channel").alias("pair"), "timestamp_unix_ns")
    candidate = s.withColumn("pair", F.pmod(F.col("pair") + 13, F.lit(14)))
    return series.overlap(s, candidate, "pair", "timestamp_unix_ns").select("pair", "n", "m", F.col("start").alias("start_ns"), F.col("end").alias("end_ns"))


@query("detrend_rms", "SELECT user_id % 14 AS channel, round(avg(value), 6) mean, round(stddev_pop(value), 6) rms FROM events GROUP BY 1")
def detrend_rms(spark, sf):
    return series.detrended(samples(spark, sf), "channel", "value").select("channel", _r("mean"), _r("rms"))


@query("dedupe_first", "WITH x AS (SELECT user_id % 14 AS channel, event_id // 3 AS bucket, event_id, value, row_number() OVER (PARTITION BY user_id % 14, event_id // 3 ORDER BY event_id) n FROM events) SELECT channel, bucket, event_id, round(value, 6) AS value FROM x WHERE n = 1")
def dedupe_first(spark, sf):
    d = samples(spark, sf).withColumn("bucket", F.floor(F.col("event_id") / 3).cast("bigint"))
    return series.dedupe_first(d, ["channel"], "bucket", "event_id").select("channel", "bucket", "event_id", _r("value"))


def _grid(spark, sf):
    """Channels a and a + 1 side by side by row number: a grid of equal steps."""
    s = samples(spark, sf)
    g = ordered.numbered(s, ["channel"], "timestamp_unix_ns", ordered.HOUR_NS * 24, ["event_id"]).select("channel", "value", "i")
    y = g.select(F.pmod(F.col("channel") + 13, F.lit(14)).alias("channel"), "i", F.col("value").alias("y"))
    return g.select("channel", "i", F.col("value").alias("x")).join(y, ["channel", "i"])


_GRID = "WITH @samples, g AS (SELECT channel, value, CAST(row_number() OVER (PARTITION BY channel ORDER BY timestamp_unix_ns, event_id) - 1 AS BIGINT) i FROM samples), z AS (SELECT a.channel, a.i, a.value x, b.value y FROM g a JOIN g b ON b.channel = (a.channel + 1) % 14 AND a.i = b.i) "
_LAG = ", mm AS (SELECT {k}, avg(x) mx, avg(y) my FROM {z} GROUP BY {k}), c AS (SELECT {ka}, a.i - b.i lag, round(sum((a.x - mx) * (b.y - my)), 6) c FROM {z} a JOIN {z} b USING ({k}) JOIN mm USING ({k}) GROUP BY ALL) SELECT {k}, arg_min(lag, (-c, lag)) lag_samples FROM c GROUP BY {k}"


@query("xcorr_lag", _GRID + _LAG.format(k="channel", ka="channel", z="z"))
def xcorr_lag(spark, sf):
    return series.xcorr_lag(_grid(spark, sf), "channel").select("channel", "lag_samples")


_WIN = "st AS (SELECT DISTINCT unnest(list_append(range(0, greatest(n - 64 + 1, 1), 32), greatest(n - 64, 0))) w, channel FROM (SELECT channel, count(*) n FROM z GROUP BY channel)), zw AS (SELECT z.channel, st.w window_start, z.i, z.x, z.y FROM z JOIN st ON z.channel = st.channel AND z.i >= st.w AND z.i < st.w + 64)"


@query("window_lag", _GRID + "," + _WIN + _LAG.format(k="channel, window_start", ka="channel, window_start", z="zw"))
def window_lag(spark, sf):
    d = series.windows(_grid(spark, sf).withColumnRenamed("i", "o"), "channel", "o", 64, ordered.MILLION)
    return series.best_lag(d, ["channel", "window_start"], "i", "x", "y", 63)  # all lags of 64 rows


@query("window_amplitude", _GRID + "," + _WIN + " SELECT channel, window_start, round(avg(i), 6) center, round(stddev_pop(y) / stddev_pop(x), 6) ratio FROM zw GROUP BY ALL")
def window_amplitude(spark, sf):
    d = series.windows(_grid(spark, sf).withColumnRenamed("i", "o"), "channel", "o", 64, ordered.MILLION)
    return d.groupBy("channel", "window_start").agg(F.round(F.avg("i"), 6).alias("center"), F.round(F.try_divide(F.stddev_pop("y"), F.stddev_pop("x")), 6).alias("ratio"))


@query("drift_slope", _GRID + "," + _WIN + ", r AS (SELECT channel, avg(i) c, stddev_pop(y) / stddev_pop(x) q FROM zw GROUP BY channel, window_start) SELECT channel, round(CASE WHEN count(*) = 1 THEN 0 ELSE regr_slope(q, c) END, 6) slope, round(CASE WHEN count(*) = 1 THEN max(q) ELSE regr_intercept(q, c) END, 5) intercept, round(avg(q), 6) mean_ratio FROM r GROUP BY channel")
def drift_slope(spark, sf):
    d = series.windows(_grid(spark, sf).withColumnRenamed("i", "o"), "channel", "o", 64, ordered.MILLION)
    r = d.groupBy("channel", "window_start").agg(F.avg("i").alias("c"), F.try_divide(F.stddev_pop("y"), F.stddev_pop("x")).alias("q"))
    out = series.slope(r, "channel", "c", "q").join(r.groupBy("channel").agg(F.avg("q").alias("mean_ratio")), "channel")
    return out.select("channel", _r("slope"), _r("intercept", 5), _r("mean_ratio"))


_LIMITS = [("max_rmse", 60.0), ("max_mae", 50.0), ("min_pearson_correlation", -0.02)]
_CHECKS = _AL + ", q AS (SELECT pair, sqrt(avg(e*e)) rmse, avg(a) mae, corr(r, i) pc FROM ok GROUP BY pair), k AS (SELECT pair, 0 nth, 'max_rmse' threshold, rmse AS value, 60.0::DOUBLE lim, rmse <= 60 passed FROM q UNION ALL SELECT pair, 1, 'max_mae', mae, 50.0, mae <= 50 FROM q UNION ALL SELECT pair, 2, 'min_pearson_correlation', pc, -0.02, pc >= -0.02 FROM q) "


def _checked(spark, sf):
    return series.checks(series.summary(_pairs(spark, sf), "pair"), "pair", _LIMITS)


@query("threshold_checks", _CHECKS + "SELECT pair, threshold, round(value, 6) AS value, lim AS \"limit\", passed FROM k")
def threshold_checks(spark, sf):
    return _checked(spark, sf).select("pair", "threshold", _r("value"), "limit", "passed")


@query("suite_report", _CHECKS + "SELECT pair, bool_and(passed) passed, coalesce(string_agg(CASE WHEN NOT passed THEN threshold END, ',' ORDER BY nth), '') failed FROM k GROUP BY pair")
def suite_report(spark, sf):
    return series.report(_checked(spark, sf), "pair")


@query("validation_metrics")
def validation_metrics(spark, sf):
    """The whole comparison of each pair of channels: common grid, lag, alignment, errors, drift. Tested against numpy."""
    s = _seconds(spark, sf).select(F.col("channel").alias("pair"), "t", F.col("value").alias("v"), "event_id")
    candidate = s.withColumn("pair", F.pmod(F.col("pair") + 13, F.lit(14)))
    found = suite.metrics(*suite.align(s, candidate, "pair", "event_id", _DAY / 1e9), "pair", _DAY / 1e9)
    return found.select("pair", "error", "grid_samples", "lag_samples", "n", *[_r(c) for c in ("rmse", "mae", "max_abs_error", "abs_error_p95", "pearson_correlation", "mean_amplitude_ratio")], *[F.round(c, 9).alias(c) for c in ("lag_sec_per_sec", "amplitude_ratio_per_sec")])


@query("finite_filter", "SELECT event_id FROM events WHERE event_id % 6 NOT IN (0, 1, 2)")
def finite_filter(spark, sf):
    i = F.col("event_id") % 6
    v = F.when(i == 0, F.lit(float("nan"))).when(i == 1, F.lit(float("-inf"))).when(i == 2, F.lit(None).cast("double")).otherwise(F.lit(1.0))
    return table(spark, sf, "events").where(finite(v)).select("event_id")


@query("plausible_filter", "SELECT event_id, round(value, 6) AS value FROM events WHERE abs(value) < 100")
def plausible_filter(spark, sf):
    return table(spark, sf, "events").where(finite(F.col("value")) & (F.abs("value") < 100)).select("event_id", _r("value"))


_REF = "WITH x AS (SELECT doc, line, CASE WHEN line = 0 THEN NULL ELSE (line // 2)::DOUBLE END t FROM (SELECT n_nationkey doc FROM nation), (SELECT unnest(range(8)) line)), k AS (SELECT doc, t, min(line) line FROM x WHERE line > 0 AND line <> 5 GROUP BY doc, t) "


@query("ref_table_long", _REF + "SELECT CAST(doc AS BIGINT) doc, t, CAST(c AS BIGINT) channel, (line + c)::DOUBLE v FROM k, (SELECT unnest(range(2)) c)")
def ref_table_long(spark, sf):
    d = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("doc"), F.explode(F.sequence(F.lit(-1), F.lit(7))).alias("line"))
    sep = F.when(F.col("doc") % 3 == 0, ",").when(F.col("doc") % 3 == 1, "\t").otherwise("  ")
    row = F.concat_ws("|", F.floor(F.col("line") / 2).cast("string"), F.col("line").cast("string"), (F.col("line") + 1).cast("string"))
    text = F.when(F.col("line") == -1, "recorder 7").when(F.col("line") == 0, "Time|a|b").when(F.col("line") == 5, "bad|row").otherwise(row)
    return series.reference_long(d.select("doc", "line", F.replace(text, F.lit("|"), sep).alias("text")), "text", "line", "doc").select("doc", "t", F.col("channel").cast("bigint").alias("channel"), "v")


@query("inspect_reference", _REF + ", d AS (SELECT doc, t - lag(t) OVER (PARTITION BY doc ORDER BY t) d FROM k) SELECT CAST(doc AS BIGINT) doc, (SELECT CAST(count(*) AS BIGINT) FROM k WHERE k.doc = d.doc) n_rows, quantile_cont(d, .5) dt, 1 / quantile_cont(d, .5) rate, '0,1' channels FROM d WHERE d > 0 GROUP BY doc")
def inspect_reference(spark, sf):
    long = ref_table_long(spark, sf)
    times = long.select("doc", "t").distinct()
    n = times.groupBy("doc").agg(F.count("*").alias("n_rows"))
    channels = long.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_set("channel")), lambda c: c.cast("string")), ",").alias("channels"))
    return n.join(series.rate(times, "doc", "t", ordered.HOUR), "doc").join(channels, "doc")


@query("trigger_windows", "SELECT event_id, round(p * f / (1 - f), 9) pre, round(p, 9) post FROM (SELECT event_id, greatest(0.01, (event_id % 7) / 100.0 - 0.01)::DOUBLE p, least(0.95, greatest(0, (event_id % 13) * 10 / 100.0))::DOUBLE f FROM events)")
def trigger_windows(spark, sf):
    pre, post = trigger.windows((F.col("event_id") % 7) / 100 - 0.01, (F.col("event_id") % 13 * 10).cast("double"))
    return table(spark, sf, "events").select("event_id", F.round(pre, 9).alias("pre"), F.round(post, 9).alias("post"))


_EDGE = "WITH @samples, l AS (SELECT channel, timestamp_unix_ns ns, value, event_id, lag(value) OVER (PARTITION BY channel ORDER BY timestamp_unix_ns, event_id) p FROM samples), ed AS (SELECT * FROM l WHERE p <= 90 AND value > 90)"


def _edges(spark, sf):
    return trigger.edges(samples(spark, sf), "channel", "timestamp_unix_ns", "value", 90.0, order="event_id", width=_DAY)


@query("trigger_edges", _EDGE + " SELECT channel, ns timestamp_unix_ns, round(value, 6) AS value FROM ed")
def trigger_edges(spark, sf):
    return _edges(spark, sf).select("channel", "timestamp_unix_ns", _r("value"))


@query("trigger_single", _EDGE + " SELECT channel, min(ns) trigger_ns FROM ed GROUP BY channel")
def trigger_single(spark, sf):
    return trigger.single(_edges(spark, sf), "channel", "timestamp_unix_ns")


@query("trigger_capture", _EDGE + f", t AS (SELECT channel, min(ns) tn FROM ed GROUP BY channel) SELECT s.channel, tn trigger_ns, s.timestamp_unix_ns, round(s.value, 6) AS value FROM samples s JOIN t USING (channel) WHERE s.timestamp_unix_ns BETWEEN tn - {6 * _HOUR} AND tn + {12 * _HOUR}")
def trigger_capture(spark, sf):
    t = trigger.single(_edges(spark, sf), "channel", "timestamp_unix_ns")
    return trigger.capture(samples(spark, sf), t, "channel", "timestamp_unix_ns", 6 * _HOUR, 12 * _HOUR).select("channel", "trigger_ns", "timestamp_unix_ns", _r("value"))


@query("prebuffer_ready", f"WITH @samples SELECT event_id, count(*) OVER w >= 2 AND timestamp_unix_ns - min(timestamp_unix_ns) OVER w >= {5 * _HOUR} ready FROM samples WINDOW w AS (PARTITION BY channel ORDER BY timestamp_unix_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def prebuffer_ready(spark, sf):
    return trigger.prebuffer_ready(samples(spark, sf), "channel", "timestamp_unix_ns", 5 * _HOUR, "event_id", _DAY).select("event_id", "ready")


@query("downsample_minmax", """WITH @samples, d AS (SELECT channel, timestamp_unix_ns ns, value, row_number() OVER (PARTITION BY channel ORDER BY timestamp_unix_ns, event_id) - 1 i, count(*) OVER (PARTITION BY channel) n FROM samples),
b AS (SELECT *, CASE WHEN n <= 64 THEN i ELSE i // CAST(ceil(n / 32.0) AS BIGINT) END bk FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY channel, bk ORDER BY value, ns) lo, row_number() OVER (PARTITION BY channel, bk ORDER BY value DESC, ns) hi FROM b)
SELECT channel, ns timestamp_unix_ns, round(value, 6) AS value FROM r WHERE lo = 1 OR hi = 1""")
def downsample_minmax(spark, sf):
    return display.downsample_minmax(samples(spark, sf), "channel", "timestamp_unix_ns", "value", 32, "event_id", _DAY).select("channel", "timestamp_unix_ns", _r("value"))


@query("value_range", "SELECT user_id % 14 AS channel, round(min(value), 6) low, round(max(value), 6) high FROM events GROUP BY 1")
def value_range(spark, sf):
    return display.value_range(samples(spark, sf), "channel", "value").select("channel", _r("low"), _r("high"))


_STEP = "CASE WHEN f <= 1 THEN 1.0 WHEN f <= 2 THEN 2.0 WHEN f <= 5 THEN 5.0 ELSE 10.0 END * pw"


@query("axis_range", f"""WITH x AS (SELECT user_id, min(value) lo, max(value) hi, greatest(max(value) - min(value), 0.08) * 1.2 / 8 st FROM events GROUP BY user_id), y AS (SELECT *, power(10.0, floor(log10(st))) pw FROM x), z AS (SELECT *, round(st / pw, 9) f FROM y),
s AS (SELECT *, greatest(0.01, {_STEP}) step FROM z), a AS (SELECT *, round(floor(((lo + hi) / 2 - step * 4) / step) * step, 6) low FROM s) SELECT user_id, low, round(low + step * 8, 6) high, round(step, 9) step, CAST(CASE WHEN step >= 1 THEN 2 ELSE least(6, greatest(2, ceil(round(-log10(step), 9)))) END AS BIGINT) decimals FROM a""")
def axis_range(spark, sf):
    r = display.value_range(table(spark, sf, "events"), "user_id", "value")
    low, high, step = display.axis(F.col("low"), F.col("high"))
    return r.select("user_id", low.alias("l"), high.alias("h"), step.alias("step")).select("user_id", F.col("l").alias("low"), F.col("h").alias("high"), F.round("step", 9).alias("step"), display.axis_decimals(F.col("step")).cast("bigint").alias("decimals"))


@query("axis_map", "SELECT event_id, round(80 + (1 - (event_id % 100) / 100.0) * 680, 6) x, round(30 + (1 - value / 200) * 320, 6) y, round(30 + (value / 200) * 320, 6) y_inverted FROM events")
def axis_map(spark, sf):
    # plot of 800 x 400 with margins 30, 40, 50, 80; a window of 100 s; values 0 to 200
    at = lambda x, span, *a: F.round(display.axis_position(x, F.lit(0.0), F.lit(span), *a), 6)
    e, back, v = table(spark, sf, "events"), (F.col("event_id") % 100).cast("double"), F.col("value")
    return e.select("event_id", at(back, 100.0, 80, 680, True).alias("x"), at(v, 200.0, 30, 320, True).alias("y"), at(v, 200.0, 30, 320).alias("y_inverted"))


@query("auto_window", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 1.0::DOUBLE ELSE greatest(0.05, 1000.0 / (event_id % 10 * 5000))::DOUBLE END window_sec, CAST(ceil((event_id % 10 * 5000) * 2.0 * CASE WHEN event_id % 10 = 0 THEN 1.0::DOUBLE ELSE greatest(0.05, 1000.0 / (event_id % 10 * 5000))::DOUBLE END) AS BIGINT) points FROM events")
def auto_window(spark, sf):
    rate = (F.col("event_id") % 10 * 5000).cast("double")
    window, points = display.auto_window(rate)
    return table(spark, sf, "events").select("event_id", window.alias("window_sec"), points.alias("points"))


@query("rolling_buffer", "WITH @samples, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY timestamp_unix_ns DESC, event_id DESC) n FROM samples) SELECT channel, timestamp_unix_ns FROM r WHERE n <= 25")
def rolling_buffer(spark, sf):
    return display.last_rows(samples(spark, sf), "channel", "timestamp_unix_ns", 25, "event_id").select("channel", "timestamp_unix_ns")


_BACK = "WITH @samples, n AS (SELECT channel, max(timestamp_unix_ns) m FROM samples GROUP BY channel) SELECT channel, timestamp_unix_ns FROM samples JOIN n USING (channel) WHERE timestamp_unix_ns >= m - {0}"


@query("lookback_slice", _BACK.format(100 * _HOUR))
def lookback_slice(spark, sf):
    return display.look_back(samples(spark, sf), "channel", "timestamp_unix_ns", 100 * _HOUR).select("channel", "timestamp_unix_ns")


@query("visible_window", f"WITH @samples, n AS (SELECT max(timestamp_unix_ns) m FROM samples) SELECT channel, timestamp_unix_ns, round(value, 6) AS value FROM samples, n WHERE timestamp_unix_ns BETWEEN m - {48 * _HOUR} AND m")
def visible_window(spark, sf):
    s = samples(spark, sf)
    now = s.agg(F.max("timestamp_unix_ns").alias("m"))  # one row
    return s.join(F.broadcast(now)).where(F.col("timestamp_unix_ns").between(F.col("m") - 48 * _HOUR, F.col("m"))).select("channel", "timestamp_unix_ns", _r("value"))


@query("running_extrema", "WITH @samples SELECT event_id, round(min(value) OVER w, 6) low, round(max(value) OVER w, 6) high FROM samples WINDOW w AS (PARTITION BY channel ORDER BY timestamp_unix_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_extrema(spark, sf):
    return display.running_extrema(samples(spark, sf), "channel", "timestamp_unix_ns", "value", "event_id", _DAY).select("event_id", _r("low"), _r("high"))


@query("segment_breaks", "WITH x AS (SELECT user_id % 14 AS channel, event_id, (event_id * 37 % 680)::DOUBLE x FROM events), y AS (SELECT *, lag(x) OVER (PARTITION BY channel ORDER BY event_id) px FROM x) SELECT channel, event_id, CAST(sum(CASE WHEN px IS NULL OR abs(x - px) > 170 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) segment FROM y")
def segment_breaks(spark, sf):
    d = samples(spark, sf).withColumn("_order", F.col("event_id")).withColumn("x", (F.col("event_id") * 37 % 680).cast("double"))
    return display.segments(d, "channel", "timestamp_unix_ns", "x", 680.0).select("channel", "event_id", "segment")


@query("effective_rate", "WITH @samples SELECT channel, CAST(round(1e9 * 86400 * count(*) / (max(timestamp_unix_ns) - min(timestamp_unix_ns))) AS BIGINT) rate_per_day FROM samples GROUP BY channel HAVING max(timestamp_unix_ns) > min(timestamp_unix_ns)")
def effective_rate(spark, sf):
    return display.effective_rate(samples(spark, sf), "channel", "timestamp_unix_ns", _DAY).withColumnRenamed("rate", "rate_per_day")


@query("latest_per_channel", "WITH @samples SELECT channel, arg_max(event_id, timestamp_unix_ns) event_id, max(timestamp_unix_ns) timestamp_unix_ns FROM samples GROUP BY channel")
def latest_per_channel(spark, sf):
    return samples(spark, sf).groupBy("channel").agg(F.max_by("event_id", "timestamp_unix_ns").alias("event_id"), F.max("timestamp_unix_ns").alias("timestamp_unix_ns"))


@query("nearest_point", f"WITH @samples, m AS (SELECT min(timestamp_unix_ns) + {100 * _HOUR} t FROM samples) SELECT channel, arg_min(event_id, (abs(timestamp_unix_ns - t), timestamp_unix_ns)) event_id FROM samples, m GROUP BY channel")
def nearest_point(spark, sf):
    s = samples(spark, sf)
    at = s.agg((F.min("timestamp_unix_ns") + 100 * _HOUR).alias("t"))  # one row
    return display.nearest_point(s.join(F.broadcast(at)), "channel", "timestamp_unix_ns", F.col("t"), "event_id")


@query("pick_channels", "WITH c AS (SELECT DISTINCT user_id, user_id % 14 ch, CASE WHEN user_id % 14 IN (3, 5) THEN 0 ELSE 1 END o, user_id % 5 box FROM events), r AS (SELECT DISTINCT box, ch, o FROM c), x AS (SELECT *, row_number() OVER (PARTITION BY box ORDER BY o, ch) n FROM r) SELECT box, ch AS channel FROM x WHERE n <= 2")
def pick_channels(spark, sf):
    d = table(spark, sf, "events").select((F.col("user_id") % 5).alias("box"), (F.col("user_id") % 14).alias("channel")).distinct()
    return display.pick_channels(d, "box", "channel", [3, 5])


@query("retention_cap", "WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) s FROM lineitem) SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) l_linenumber FROM x WHERE s <= 300")
def retention_cap(spark, sf):
    d = display.within_cap(table(spark, sf, "lineitem"), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", 300)
    return d.select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))
