"""Queries over scan batches, samples, calibrations and keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from samplewell.functions import timefmt
from samplewell.operators import calibrate, keys, scans as ops
from samplewell.plans.registry import INTERVAL_NS, kv, query, samples, scans, table


@query("batch_validate", "WITH @scans SELECT sequence, CASE WHEN sequence % 11 = 0 THEN 'empty' WHEN sequence % 7 = 0 THEN 'ragged' ELSE 'ok' END status FROM scans")
def batch_validate(spark, sf):
    s = scans(spark, sf)
    v = F.when(F.col("sequence") % 11 == 0, F.array().cast("array<double>")).when(F.col("sequence") % 7 == 0, F.slice("values", 1, 63)).otherwise(F.col("values"))
    return s.select("sequence", ops.batch_status(v, F.lit(2)).alias("status"))


@query("deinterleave", "WITH @scans, e AS (SELECT sequence, unnest(range(64)) pos, unnest(embedding) v FROM scans) SELECT sequence, CAST(pos % 4 AS BIGINT) channel_index, CAST(pos // 4 AS BIGINT) scan_index, round(CAST(v AS DOUBLE), 6) AS value FROM e")
def deinterleave(spark, sf):
    d = ops.deinterleave(scans(spark, sf).withColumn("n", F.lit(4)), "values", "n")
    return d.select("sequence", "channel_index", "scan_index", F.round("value", 6).alias("value"))


_EXPAND = f"WITH @scans, e AS (SELECT channel, sequence, unnest(range(64)) i, unnest(embedding) v, first_ns FROM scans) SELECT channel, sequence, CAST(i AS BIGINT) sample_index, first_ns + i*{INTERVAL_NS} timestamp_unix_ns, round(CAST(v AS DOUBLE), 6) AS value FROM e"


@query("scan_expand", _EXPAND)
def scan_expand(spark, sf):
    return ops.expand(scans(spark, sf)).select("channel", "sequence", F.col("sample_index").cast("bigint").alias("sample_index"), "timestamp_unix_ns", F.round("value", 6).alias("value"))


@query("scan_expand_ms", f"WITH @scans, e AS (SELECT sequence, unnest(range(64)) i, first_ns FROM scans) SELECT sequence, CAST(i AS BIGINT) sample_index, round((first_ns + i*{INTERVAL_NS}) / 1000000.0, 3) ms FROM e")
def scan_expand_ms(spark, sf):
    return ops.expand(scans(spark, sf)).select("sequence", F.col("sample_index").cast("bigint").alias("sample_index"), F.round(F.col("timestamp_unix_ns").cast("double") / 1e6, 3).alias("ms"))


@query("scan_overflow_guard", f"WITH @scans, e AS (SELECT sequence, unnest(range(64)) i FROM scans) SELECT sequence, CAST(count(*) AS BIGINT) kept FROM e WHERE i * {INTERVAL_NS} <= 63 * {INTERVAL_NS} - (sequence % 32) * {INTERVAL_NS} GROUP BY sequence")
def scan_overflow_guard(spark, sf):
    first = F.lit(9223372036854775807) - 63 * INTERVAL_NS + (F.col("sequence") % 32) * INTERVAL_NS
    return ops.expand(scans(spark, sf).withColumn("first_sample_unix_ns", first)).groupBy("sequence").agg(F.count("*").alias("kept"))


@query("scan_reject_nonfinite", "WITH @scans SELECT sequence FROM scans WHERE sequence % 5 <> 0")
def scan_reject_nonfinite(spark, sf):
    v = F.when(F.col("sequence") % 5 == 0, F.concat("values", F.array(F.lit(float("nan"))))).otherwise(F.col("values"))
    return scans(spark, sf).withColumn("values", v).where((F.size("values") > 0) & F.forall("values", ops.finite)).select("sequence")


@query("sample_interval", "SELECT event_id, CASE WHEN value > 0 THEN CAST(round(1e9 / round(value * 100, 2)) AS BIGINT) END interval_ns FROM events")
def sample_interval(spark, sf):
    return table(spark, sf, "events").select("event_id", ops.sample_interval_ns(F.round(F.col("value") * 100, 2)).alias("interval_ns"))


@query("stream_clock", f"""WITH @scans, c AS (SELECT channel, sequence o, 10 + sequence % 5 n FROM scans WHERE sequence % 13 <> 0)
SELECT channel, o AS arrival, CAST(row_number() OVER w - 1 AS BIGINT) AS sequence, CAST(1704067200000000000 + coalesce(sum(n*{INTERVAL_NS}) OVER (PARTITION BY channel ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) first_sample_unix_ns FROM c WINDOW w AS (PARTITION BY channel ORDER BY o)""")
def stream_clock(spark, sf):
    s = scans(spark, sf).select("channel", F.col("sequence").alias("arrival"), F.when(F.col("sequence") % 13 == 0, F.lit(0)).otherwise(10 + F.col("sequence") % 5).alias("n"))
    return ops.stream_clock(s, "channel", "arrival", F.col("n"), F.lit(INTERVAL_NS), F.lit(1704067200000000000)).select("channel", "arrival", "sequence", "first_sample_unix_ns")


@query("sequence_gaps", "WITH @scans, l AS (SELECT channel, sequence, lag(sequence) OVER (PARTITION BY channel ORDER BY sequence) p FROM scans) SELECT channel, sequence, CASE WHEN p IS NULL THEN 'first' WHEN sequence = p+1 THEN 'ok' WHEN sequence > p+1 THEN 'gap' ELSE 'reset' END state, CAST(CASE WHEN sequence > p+1 THEN sequence-p-1 ELSE 0 END AS BIGINT) missing FROM l")
def sequence_gaps(spark, sf):
    return ops.sequence_state(scans(spark, sf), "channel", "sequence", "sequence").select("channel", "sequence", "state", "missing")


@query("scan_debug_rows", f"WITH @scans, e AS (SELECT channel, sequence, unnest(range(64)) i, unnest(embedding) v, first_ns FROM scans) SELECT 'ch' || lpad(CAST(channel AS VARCHAR), 2, '0') AS channel, sequence, first_ns + i*{INTERVAL_NS} AS ns, round(CAST(v AS DOUBLE), 6) raw_value FROM e")
def scan_debug_rows(spark, sf):
    return ops.expand(scans(spark, sf)).select(keys.padded_channel(F.col("channel")).alias("channel"), "sequence", F.col("timestamp_unix_ns").alias("ns"), F.round("value", 6).alias("raw_value"))


@query("rows_by_partition", "WITH @samples SELECT asset, strftime(make_timestamp(timestamp_unix_ns // 1000), '%Y-%m-%d') AS \"date\", channel, CAST(count(*) AS BIGINT) n FROM samples GROUP BY ALL")
def rows_by_partition(spark, sf):
    return samples(spark, sf).groupBy("asset", timefmt.utc_date(F.col("timestamp_unix_ns")).cast("string").alias("date"), "channel").agg(F.count("*").alias("n"))


_LIN, _POLY = [2.5, -0.01], [0.0, 1.0, 0.5]


def _spec(kind, a=None, b=None, coeffs=None, id=None):
    return F.struct(F.lit(id).cast("string").alias("id"), F.lit(kind).alias("type"), F.lit(a).cast("double").alias("a"), F.lit(b).cast("double").alias("b"), (F.array(*map(F.lit, coeffs)) if coeffs else F.lit(None)).cast("array<double>").alias("coeffs"))


def _calibrated(spark, sf, spec):
    return samples(spark, sf).select("event_id", F.round(calibrate.apply(F.col("value"), spec), 6).alias("calibrated_value"), F.coalesce(spec["id"], F.lit("identity")).alias("calibration_id"))


@query("calibrate_identity", "SELECT event_id, round(value, 6) calibrated_value, 'identity' calibration_id FROM events")
def calibrate_identity(spark, sf):
    return _calibrated(spark, sf, _spec("identity"))


@query("calibrate_linear", "SELECT event_id, round(2.5*value + -0.01, 6) calibrated_value, 'load-cell-a' calibration_id FROM events")
def calibrate_linear(spark, sf):
    return _calibrated(spark, sf, _spec("linear", *_LIN, id="load-cell-a"))


@query("calibrate_polynomial", "SELECT event_id, round(((0.5::DOUBLE)*value + 1)*value + 0, 6) calibrated_value, 'p' calibration_id FROM events")
def calibrate_polynomial(spark, sf):
    return _calibrated(spark, sf, _spec("polynomial", coeffs=_POLY, id="p"))


def _dimension(spark):
    rows = [(0, ("zero", "identity", None, None, None)), (1, ("load-cell-a", "linear", 2.5, -0.01, None)), (2, ("p", "polynomial", None, None, _POLY))]
    return spark.createDataFrame(rows, f"channel bigint, spec struct<{', '.join(p.replace(' ', ':') for p in calibrate.SPEC.split(', '))}>")


_CASE = "CASE channel WHEN 1 THEN 2.5*value - 0.01 WHEN 2 THEN (0.5::DOUBLE*value + 1)*value ELSE value END"
_ID = "CASE channel WHEN 0 THEN 'zero' WHEN 1 THEN 'load-cell-a' WHEN 2 THEN 'p' ELSE 'identity' END"


@query("calibrate_join", f"WITH @samples SELECT event_id, channel, round({_CASE}, 6) calibrated_value, {_ID} calibration_id FROM samples")
def calibrate_join(spark, sf):
    d = calibrate.with_calibration(samples(spark, sf), F.broadcast(_dimension(spark)), ["channel"])
    return d.select("event_id", "channel", F.round("calibrated_value", 6).alias("calibrated_value"), "calibration_id")


_DAY = 86_400_000_000_000


@query("calibration_asof", f"""WITH @samples, lo AS (SELECT min(timestamp_unix_ns) // {_DAY} * {_DAY} t0 FROM samples),
x AS (SELECT event_id, channel, value, (timestamp_unix_ns - t0) // (3*{_DAY}) period FROM samples, lo)
SELECT event_id, channel, round(CASE WHEN channel < 7 THEN value * (1 + period) ELSE value END, 6) calibrated_value, CASE WHEN channel < 7 THEN 'c' || channel || '-' || period ELSE 'identity' END calibration_id FROM x""")
def calibration_asof(spark, sf):
    s = samples(spark, sf)
    lo = s.agg(F.min("timestamp_unix_ns").alias("lo"), F.max("timestamp_unix_ns").alias("hi"))
    t0 = F.col("lo") - F.pmod("lo", F.lit(_DAY))
    periods = lo.select(t0.alias("t0"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("hi") - t0) / (3 * _DAY)).cast("bigint"))).alias("period"))
    spec = F.struct(F.concat(F.lit("c"), F.col("channel").cast("string"), F.lit("-"), F.col("period").cast("string")).alias("id"), F.lit("linear").alias("type"), (1.0 + F.col("period")).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("array<double>").alias("coeffs"))
    intervals = periods.withColumn("channel", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint")))).select(
        "channel", (F.col("t0") + F.col("period") * 3 * _DAY).alias("effective_from_ns"), (F.col("t0") + (F.col("period") + 1) * 3 * _DAY).alias("effective_to_ns"), spec.alias("spec"))
    d = calibrate.as_of(s, intervals)
    return d.select("event_id", "channel", F.round(calibrate.apply(F.col("value"), F.col("spec")), 6).alias("calibrated_value"), F.coalesce(F.col("spec")["id"], F.lit("identity")).alias("calibration_id"))


@query("calibration_normalize", "SELECT vec_id, CASE WHEN vec_id % 4 = 1 THEN 'linear' WHEN vec_id % 4 = 2 THEN 'polynomial' ELSE 'identity' END kind, CASE WHEN vec_id % 4 = 1 THEN CASE WHEN vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END END a, CASE WHEN vec_id % 4 = 1 THEN 0.0::DOUBLE END b, CASE WHEN vec_id % 4 = 2 THEN CASE WHEN vec_id % 3 = 0 THEN '0.0,1.0' ELSE '3.0' END END coeffs FROM embeddings")
def calibration_normalize(spark, sf):
    i = F.col("vec_id")
    kind = F.when(i % 4 == 1, "linear").when(i % 4 == 2, "polynomial").when(i % 4 == 3, "spline").otherwise("identity")
    nan = F.lit(float("nan"))
    spec = F.struct(F.lit("x").alias("id"), kind.alias("type"), F.when(i % 3 == 0, nan).otherwise(F.lit(2.0)).alias("a"), F.lit(None).cast("double").alias("b"), F.when(i % 3 == 0, F.array(nan)).otherwise(F.array(F.lit(3.0), nan)).alias("coeffs"))
    n = table(spark, sf, "embeddings").select("vec_id", calibrate.normalize(spec).alias("s"))
    return n.select("vec_id", F.col("s.type").alias("kind"), "s.a", "s.b", F.when(F.col("s.coeffs").isNotNull(), F.array_join(F.transform("s.coeffs", lambda c: c.cast("string")), ",")).alias("coeffs"))


@query("calibration_map_explode", "SELECT vec_id, CAST(label AS BIGINT) channel, 'linear' kind FROM embeddings")
def calibration_map_explode(spark, sf):
    spec = F.lit('{"type":"linear","a":2}')
    text = F.concat(F.lit('{"'), F.col("label").cast("string"), F.lit('":'), spec, F.lit(',"x":'), spec, F.lit(',"256":'), spec, F.lit("}"))
    d = table(spark, sf, "embeddings").select("vec_id", F.from_json(text, "map<string, struct<id:string,type:string,a:double,b:double,coeffs:array<double>>>").alias("m"))
    return calibrate.explode_map(d, "m").select("vec_id", F.col("channel").cast("bigint").alias("channel"), F.col("spec.type").alias("kind"))


@query("coeff_parse", "SELECT user_id, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 3 ELSE 2 END) AS BIGINT) n, round(sum(CASE WHEN user_id % 2 = 0 THEN 2.5 + user_id ELSE 0.5 + user_id END), 6) total FROM events GROUP BY user_id")
def coeff_parse(spark, sf):
    text = F.concat(F.lit("0.5, x, "), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, F.lit(",,2")).otherwise(F.lit(",,NaN")))
    parsed = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("double")), ops.finite)
    d = table(spark, sf, "events").select("user_id", parsed.alias("c"))
    return d.groupBy("user_id").agg(F.sum(F.size("c")).alias("n"), F.round(F.sum(F.aggregate("c", F.lit(0.0), lambda a, c: a + c)), 6).alias("total"))


_SAN = r"regexp_replace(lower(regexp_replace(regexp_replace(trim({0}), '{1}', '-', 'g'), '[^A-Za-z0-9_-]', '', 'g')), '^-+|-+$', '', 'g')"


def _san(x, run=False):
    return f"coalesce(nullif({_SAN.format(x, chr(91) + chr(92) + 's./]' + ('+' if run else ''))}, ''), 'unknown')"


@query("sanitize_token", f"SELECT p_partkey, {_san(chr(39) + ' ' + chr(39) + ' || p_name || ' + chr(39) + '..X/y !' + chr(39))} token FROM part")
def sanitize_token(spark, sf):
    return table(spark, sf, "part").select("p_partkey", keys.sanitize(F.concat(F.lit(" "), "p_name", F.lit("..X/y !"))).alias("token"))


@query("sanitize_token_collapsed", f"SELECT page_id, {_san('url', True)} token FROM pages")
def sanitize_token_collapsed(spark, sf):
    return table(spark, sf, "pages").select("page_id", keys.sanitize(F.col("url"), True).alias("token"))


@query("sanitize_calibration_id", r"SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name || '  Cell/A.1')), '\s+', '-', 'g'), '[^a-z0-9._-]', '', 'g') id FROM customer")
def sanitize_calibration_id(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", keys.sanitize_calibration_id(F.concat("c_name", F.lit("  Cell/A.1"))).alias("id"))


_BOX = "CASE WHEN event_id % 3 = 0 THEN 'Box ' || (user_id % 5) WHEN event_id % 3 = 1 THEN '' END"


def _subject_columns(spark, sf):
    e = table(spark, sf, "events")
    box = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Box "), (F.col("user_id") % 5).cast("string"))).when(F.col("event_id") % 3 == 1, F.lit(""))
    return e.select("event_id", F.when(F.col("event_id") % 2 == 0, "plantbox").otherwise("plant").alias("subject"), box.alias("box"), F.lit(None).cast("string").alias("source"), F.col("event_type").alias("name"), F.col("user_id").alias("asset"), (F.col("user_id") % 14).alias("channel"))


_PAD2 = "lpad(CAST(user_id % 14 AS VARCHAR), 2, '0')"
_PAD3 = "CASE WHEN user_id < 100 THEN lpad(CAST(user_id AS VARCHAR), 3, '0') ELSE CAST(user_id AS VARCHAR) END"
_V1 = "(event_id % 2 = 1 OR event_id % 3 = 0)"
_SUBJ = "CASE WHEN event_id % 2 = 0 THEN 'plantbox' ELSE 'plant' END"
_BOXT = "CASE WHEN event_id % 3 = 0 THEN 'box-' || (user_id % 5) ELSE 'unknown-box' END"


@query("subject_build", f"SELECT event_id, CASE WHEN {_V1} THEN {_SUBJ} || '.v1.' || {_BOXT} || '.' || event_type || '.ch' || {_PAD2} ELSE {_SUBJ} || '.' || {_PAD3} || '.data.ch' || {_PAD2} END subject FROM events")
def subject_build(spark, sf):
    d = _subject_columns(spark, sf)
    c = F.col
    return d.select("event_id", keys.channel_subject(c("subject"), c("asset"), c("channel"), c("box"), c("source"), c("name")).alias("subject"))


@query("subject_pattern", f"SELECT event_id, CASE WHEN {_V1} THEN {_SUBJ} || '.v1.' || {_BOXT} || '.' || event_type || '.*' ELSE {_SUBJ} || '.*.data.*' END pattern FROM events")
def subject_pattern(spark, sf):
    d = _subject_columns(spark, sf)
    return d.select("event_id", keys.stream_pattern(F.col("subject"), F.col("box"), F.col("source"), F.col("name")).alias("pattern"))


@query("subject_compatible", "SELECT event_id, event_id % 3 <> 2 AS ok FROM events")
def subject_compatible(spark, sf):
    i = F.col("event_id")
    existing = F.when(i % 3 == 0, "plantbox.*.data.*").when(i % 3 == 1, F.concat(F.lit("plantbox."), i.cast("string"), F.lit(".data.*"))).otherwise("other.1.data.*")
    return table(spark, sf, "events").select("event_id", keys.compatible(existing, F.lit("plantbox.*.data.*")).alias("ok"))


@query("subject_parse", f"SELECT event_id, 'ch' || {_PAD2} AS channel FROM events")
def subject_parse(spark, sf):
    c = F.col
    d = _subject_columns(spark, sf).withColumn("s", keys.channel_subject(c("subject"), c("asset"), c("channel"), c("box"), c("source"), c("name")))
    return d.select("event_id", keys.last_token(F.col("s")).alias("channel"))


@query("config_key", "SELECT event_id, 'v1.box-' || (user_id % 5) || '.' || event_type || '.config' config_key, 'archiver-box-' || (user_id % 5) || '-labjack-' || event_type || '-' || (user_id % 14) consumer FROM events")
def config_key(spark, sf):
    box = F.concat(F.lit("Box "), (F.col("user_id") % 5).cast("string"))
    return table(spark, sf, "events").select("event_id", keys.config_key(box, F.col("event_type")).alias("config_key"), keys.consumer_name(box, F.lit("labjack"), F.col("event_type"), F.col("user_id") % 14).alias("consumer"))


@query("server_list", "SELECT n_nationkey, 'nats://' || lower(replace(n_name, ' ', '-')) || ':4222|b:4222|c:1' servers FROM nation")
def server_list(spark, sf):
    t = F.concat(F.lit(" nats://"), F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("-"))), F.lit(":7422 ,, b:7422,c:1 "))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(keys.servers(t), "|").alias("servers"))


@query("ipv4_from_int", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN NULL ELSE '192.168.' || ((c_custkey // 256) % 256) || '.' || (c_custkey % 256) END ip FROM customer")
def ipv4_from_int(spark, sf):
    k = F.col("c_custkey")
    n = F.when(k == 1, F.lit(0)).otherwise((F.lit(-1062731776) + F.pmod(k, F.lit(65536))).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", keys.ipv4(n).alias("ip"))


@query("format_bytes", "SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%.0f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n/1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n/1048576.0) ELSE printf('%.1f GB', n/1073741824.0) END AS text FROM (SELECT o_orderkey, CAST((o_orderkey % 7 + 1) * power(13.0, o_orderkey % 9) AS BIGINT)::DOUBLE n FROM orders)")
def format_bytes(spark, sf):
    n = ((F.col("o_orderkey") % 7 + 1) * F.pow(F.lit(13.0), F.col("o_orderkey") % 9)).cast("bigint")
    return table(spark, sf, "orders").select("o_orderkey", keys.bytes_text(n).alias("text"))


@query("format_lag", "SELECT o_orderkey, CASE WHEN n < 0 THEN '--' WHEN n < 1000 THEN CAST(CAST(floor(n+0.5) AS BIGINT) AS VARCHAR) || 'ms' WHEN n < 60000 THEN printf('%.2fs', n/1000) WHEN n < 3600000 THEN printf('%.1fm', n/60000) ELSE printf('%.2fh', n/3600000) END AS text FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN -1.0 ELSE ((o_orderkey % 7 + 1) * power(7.0, o_orderkey % 9)) + 0.25 END n FROM orders)")
def format_lag(spark, sf):
    n = F.when(F.col("o_orderkey") % 10 == 0, F.lit(-1.0)).otherwise((F.col("o_orderkey") % 7 + 1) * F.pow(F.lit(7.0), F.col("o_orderkey") % 9) + 0.25)
    return table(spark, sf, "orders").select("o_orderkey", keys.lag_text(n).alias("text"))


@query("lag_latency", "SELECT event_id, greatest(0, event_id % 7 - 3) * 1000 AS latency_ms FROM events")
def lag_latency(spark, sf):
    return table(spark, sf, "events").select("event_id", keys.latency_ms((F.col("event_id") % 7) * 1_000_000_000, F.lit(3_000_000_000)).alias("latency_ms"))
