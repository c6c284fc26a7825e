"""Queries over configurations, the key-value log, export and the archive."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from samplewell.functions import timefmt
from samplewell.operators import config, export, keys
from samplewell.plans.registry import kv, query, samples, table
from samplewell.sources import archive

_LAST = "l AS (SELECT \"key\", max(revision) revision, arg_max(op, revision) op, arg_max(k, revision) k FROM kv GROUP BY \"key\")"


@query("kv_latest", f"WITH @kv, {_LAST} SELECT \"key\", revision, k FROM l WHERE op = 'PUT'")
def kv_latest(spark, sf):
    return config.latest(kv(spark, sf)).select("key", "revision", "k")


@query("kv_key_filter", "WITH @kv SELECT DISTINCT \"key\" FROM kv WHERE regexp_matches(\"key\", '^v1\\.box[13]\\.[^.]+\\.config$')")
def kv_key_filter(spark, sf):
    return kv(spark, sf).where(F.col("key").rlike(r"^v1\.box[13]\.[^.]+\.config$")).select("key").distinct()


@query("kv_change_events", "WITH @kv, p AS (SELECT \"key\", revision, k, lag(k) OVER (PARTITION BY \"key\" ORDER BY revision) q, row_number() OVER (PARTITION BY \"key\" ORDER BY revision) n FROM kv WHERE op = 'PUT') SELECT \"key\", revision, k FROM p WHERE n = 1 OR k IS DISTINCT FROM q")
def kv_change_events(spark, sf):
    return config.changes(kv(spark, sf), "k").select("key", "revision", "k")


@query("kv_history", "WITH @kv, h AS (SELECT *, row_number() OVER (PARTITION BY \"key\" ORDER BY revision DESC) age FROM kv) SELECT \"key\", revision, op, CAST(age AS BIGINT) age FROM h WHERE age <= 5")
def kv_history(spark, sf):
    return config.history(kv(spark, sf)).select("key", "revision", "op", "age")


@query("kv_mirror_diff", f"WITH @kv, {_LAST}, o AS (SELECT \"key\", arg_max(k, revision) k FROM kv WHERE op = 'PUT' AND revision % 2 = 0 GROUP BY \"key\") SELECT l.\"key\", l.k FROM l LEFT JOIN o USING (\"key\") WHERE l.op = 'PUT' AND l.k IS DISTINCT FROM o.k")
def kv_mirror_diff(spark, sf):
    log = kv(spark, sf)
    local = config.latest(log.where("op = 'PUT' and revision % 2 = 0"))
    return config.mirror_diff(config.latest(log).select("key", "k"), local, "key", "k")


@query("config_lookup", "WITH @kv, r AS (SELECT DISTINCT CAST(regexp_extract(\"key\", 'src([0-9]+)', 1) AS BIGINT) asset, \"key\" FROM kv), x AS (SELECT asset, \"key\", row_number() OVER (PARTITION BY asset ORDER BY CASE WHEN \"key\" LIKE 'v1.box3.%' THEN 0 ELSE 1 END, \"key\") n FROM r) SELECT asset, \"key\" FROM x WHERE n = 1")
def config_lookup(spark, sf):
    d = kv(spark, sf).select(F.regexp_extract("key", "src([0-9]+)", 1).cast("bigint").alias("asset"), "key")
    return config.first_match(d, "asset", "key", F.col("key").startswith("v1.box3."))


def _json(legacy: bool = False):
    i = F.col("event_id")
    scans, rate = ("scan_rate", "sampling_rate") if legacy else ("scans_per_read", "scan_rate_hz")
    return F.concat(
        F.lit('{"labjack_name":"'), F.col("event_type"), F.lit('","asset_number":'), F.col("user_id").cast("string"), F.lit(',"max_channels":'), (i % 20).cast("string"),
        F.lit(',"nats_subject":"s","nats_stream":"t","rotate_secs":300,"sensor_settings":{"' + scans + '":'), (i % 3 * 100).cast("string"), F.lit(',"' + rate + '":1000.5,"channels_enabled":['),
        F.when(i % 4 == 0, "").when(i % 4 == 1, "7").otherwise("7,11"), F.lit('],"gains":1,"data_formats":["voltage"]}}'),
    )


@query("config_parse", "SELECT event_id, event_type AS \"name\", CAST(user_id AS BIGINT) asset, CAST(event_id % 3 * 100 AS BIGINT) scans, 1000.5::DOUBLE rate FROM events WHERE event_id % 5 <> 0")
def config_parse(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, F.lit('{"labjack_name":"x"}')).when(F.col("event_id") % 2 == 0, _json(True)).otherwise(_json())
    d = table(spark, sf, "events").select("event_id", config.parse(text).alias("c")).where("c is not null")
    return d.select("event_id", F.col("c.labjack_name").alias("name"), F.col("c.asset_number").cast("bigint").alias("asset"), F.col("c.scans_per_read").cast("bigint").alias("scans"), F.col("c.scan_rate_hz").alias("rate"))


_NCH = "CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END"


@query("config_defaults", f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 60 ELSE 300 END::BIGINT rotate_secs, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type END AS \"name\", CASE WHEN event_id % 5 = 0 THEN '' WHEN {_NCH} = 2 THEN 'V,V' WHEN {_NCH} = 1 THEN 'V' ELSE '' END units, CASE WHEN event_id % 5 = 0 THEN 200 ELSE event_id % 3 * 100 END::BIGINT scans FROM events")
def config_defaults(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, F.lit("{}")).otherwise(_json())
    d = table(spark, sf, "events").select("event_id", config.with_defaults(text).alias("c"))
    return d.select("event_id", F.col("c.rotate_secs").cast("bigint").alias("rotate_secs"), F.col("c.labjack_name").alias("name"), F.array_join("c.measurement_units", ",").alias("units"), F.col("c.scans_per_read").cast("bigint").alias("scans"))


@query("config_validate", f"""WITH e AS (SELECT *, count(*) OVER (PARTITION BY user_id) na, {_NCH} n FROM events)
SELECT event_id, concat_ws(',', CASE WHEN na > 1 THEN 'asset_number' END, CASE WHEN event_id % 20 = 0 OR event_id % 20 > 16 THEN 'max_channels' END, CASE WHEN event_id % 3 = 0 THEN 'scans_per_read' END,
CASE WHEN n = 0 THEN 'channels_enabled' END, CASE WHEN n <> 1 THEN 'data_formats' END) errors FROM e""")
def config_validate(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", config.with_defaults(_json()).alias("c"))
    taken = F.count("*").over(Window.partitionBy("user_id")) > 1
    # data_formats has one entry in the text: the raw length is what the rule compares
    raw = lambda n: F.array(F.lit("voltage")) if n == "data_formats" else F.col(f"c.{n}")
    return d.select("event_id", F.array_join(config.errors(raw, F.lit(False), taken), ",").alias("errors"))


@query("config_required_keys", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'site_id' ELSE 'site_id,box_id' END first_missing, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 24 ELSE 25 END AS BIGINT) n_missing FROM nation")
def config_required_keys(spark, sf):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit('{"site_id":"","box_id":"b","source":{"type":"t","id":"i"}}')).otherwise(F.lit('{"box_id":null,"source":{"type":"t","id":"i"}}'))
    d = table(spark, sf, "nation").select("n_nationkey", config.missing_keys(text).alias("m"))
    two = F.filter("m", lambda k: k.isin("site_id", "box_id"))
    return d.select("n_nationkey", F.array_join(two, ",").alias("first_missing"), F.size("m").cast("bigint").alias("n_missing"))


@query("config_zip_units", "SELECT vec_id, string_agg(c || '=' || u, ',' ORDER BY c) pairs FROM (SELECT vec_id, unnest([label % 3 + 5, label % 3, label % 3 + 2]) c, unnest(['V', 'N', 'kg']) u FROM embeddings) GROUP BY vec_id")
def config_zip_units(spark, sf):
    b = F.col("label") % 3
    pairs = config.zipped(F.array(b + 5, b, b + 2), unit=F.array(F.lit("V"), F.lit("N"), F.lit("kg")))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(pairs, lambda p: F.concat(p["channel"].cast("string"), F.lit("="), p["unit"])), ",").alias("pairs"))


@query("config_change_kind", """WITH @kv, p AS (SELECT "key", revision, k, lag(k) OVER w q FROM kv WHERE op = 'PUT' WINDOW w AS (PARTITION BY "key" ORDER BY revision))
SELECT "key", revision, CASE WHEN q IS NULL THEN 'added' WHEN k % 10 <> q % 10 THEN 'respawn' WHEN k <> q THEN 'recalibrate' ELSE 'none' END kind FROM p""")
def config_change_kind(spark, sf):
    # the last digit stands for subject, stream, consumer, asset and rotation; the rest for the calibration
    return config.change_kinds(kv(spark, sf), [F.col("k") % 10], [F.col("k")]).select("key", "revision", "kind")


@query("channel_diff", "WITH @samples, o AS (SELECT DISTINCT asset, channel FROM samples WHERE event_id % 97 < 9), n AS (SELECT DISTINCT asset, channel FROM samples WHERE event_id % 89 < 9) SELECT asset, channel, CASE WHEN o.channel IS NULL THEN 'added' WHEN n.channel IS NULL THEN 'removed' ELSE 'kept' END AS change FROM o FULL JOIN n USING (asset, channel)")
def channel_diff(spark, sf):
    s = samples(spark, sf)
    return config.channel_diff(s.where("event_id % 97 < 9"), s.where("event_id % 89 < 9"), "asset", "channel")


@query("threshold_merge", "WITH c AS (SELECT DISTINCT CAST(label AS BIGINT) case_id FROM embeddings), d(threshold, v) AS (VALUES ('max_mae', 0.2::DOUBLE), ('max_rmse', 0.25::DOUBLE)) SELECT case_id, threshold, CASE WHEN case_id % 2 = 0 AND threshold = 'max_rmse' THEN 0.5 + case_id ELSE v END \"limit\" FROM c, d UNION ALL SELECT case_id, 'max_abs_error', 1.5 FROM c WHERE case_id % 3 = 1")
def threshold_merge(spark, sf):
    c = table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("case_id")).distinct()
    own = F.array_compact(F.array(F.when(F.col("case_id") % 2 == 0, F.struct(F.lit("max_rmse").alias("t"), (0.5 + F.col("case_id")).alias("v"))), F.when(F.col("case_id") % 3 == 1, F.struct(F.lit("max_abs_error").alias("t"), F.lit(1.5).alias("v")))))
    overrides = c.select("case_id", F.explode_outer(own).alias("o")).select("case_id", F.col("o.t").alias("threshold"), F.col("o.v").alias("limit"))
    return config.merged([("max_rmse", 0.25), ("max_mae", 0.2)], overrides, "case_id", "threshold", "limit")


@query("suite_cases", "SELECT CAST(n_nationkey AS BIGINT) case_id, n_name AS \"name\", CAST(CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey ELSE 11 END AS BIGINT) reference_channel, 'csv' input_format, CASE WHEN n_nationkey % 3 = 0 THEN 'calibrated_value' ELSE 'raw_value' END signal_column FROM nation")
def suite_cases(spark, sf):
    i = F.col("n_nationkey")
    case = F.concat(F.lit('{"name":"'), F.col("n_name"), F.lit('"'), F.when(i % 4 == 0, F.concat(F.lit(',"reference_channel":'), i.cast("string"))).otherwise(""), F.when(i % 3 == 0, ',"signal_column":"calibrated_value"').otherwise(""), F.lit("}"))
    schema = "name string, reference_channel bigint, input_format string, signal_column string"
    defaults = F.lit('{"reference_channel":11,"input_format":"csv","signal_column":"raw_value"}')
    return config.cascaded(table(spark, sf, "nation").select(i.cast("bigint").alias("case_id"), case.alias("c"), defaults.alias("d")), "d", "c", schema)


_RANGE = "channel IN (0, 1, 2) AND timestamp_unix_ns BETWEEN (SELECT min(timestamp_unix_ns) + 86400000000000 FROM samples) AND (SELECT min(timestamp_unix_ns) + 10*86400000000000 FROM samples)"
_CASE = "CASE channel WHEN 1 THEN 2.5*value - 0.01 WHEN 2 THEN (0.5::DOUBLE*value + 1)*value ELSE value END"
_ID = "CASE channel WHEN 0 THEN 'zero' WHEN 1 THEN 'load-cell-a' WHEN 2 THEN 'p' ELSE 'identity' END"


def _exported(spark, sf):
    from samplewell.plans.q_scans import _dimension

    s = samples(spark, sf)
    lo = s.agg(F.min("timestamp_unix_ns")).first()[0]  # one number: the request's bounds
    start, end = (lo + 86_400_000_000_000, lo + 10 * 86_400_000_000_000) if lo is not None else (0, -1)
    return export.export_rows(s, F.broadcast(_dimension(spark)), 1001, [2, 0, 1, 1], start, end)


@query("export_range", f"WITH @samples SELECT timestamp_unix_ns, channel, round(value, 6) raw_value, round({_CASE}, 6) calibrated_value, {_ID} calibration_id FROM samples WHERE {_RANGE}")
def export_range(spark, sf):
    return _exported(spark, sf).select("timestamp_unix_ns", "channel", F.round("raw_value", 6).alias("raw_value"), F.round("calibrated_value", 6).alias("calibrated_value"), "calibration_id")


_FRACTION = "CASE WHEN us % 1000000 = 0 THEN '' WHEN us % 1000 = 0 THEN '.' || lpad(CAST(us % 1000000 // 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') END"


@query("export_csv_rows", f"WITH @samples, x AS (SELECT *, timestamp_unix_ns // 1000 us FROM samples WHERE {_RANGE}) SELECT strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || {_FRACTION} || '+00:00' AS \"timestamp\", 'ch' || lpad(CAST(channel AS VARCHAR), 2, '0') channel, round(value, 6) raw_value, round({_CASE}, 6) calibrated_value, {_ID} calibration_id FROM x")
def export_csv_rows(spark, sf):
    d = export.csv_rows(_exported(spark, sf))
    # Digits are text here; the two engines print DOUBLE alike once it is read again and rounded.
    number = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return d.select("timestamp", "channel", number("raw_value"), number("calibrated_value"), "calibration_id")


@query("export_summary", f"WITH @samples, x AS (SELECT channel, count(*) n FROM samples WHERE {_RANGE} GROUP BY channel) SELECT CAST(r.c AS BIGINT) channel, CAST(coalesce(x.n, 0) AS BIGINT) n_rows, x.n IS NULL AS missing FROM (VALUES (0), (1), (2), (99)) r(c) LEFT JOIN x ON x.channel = r.c")
def export_summary(spark, sf):
    return export.summary(_exported(spark, sf), [0, 1, 2, 99])


@query("missing_channels", "WITH @samples SELECT CAST(c AS BIGINT) channel FROM (VALUES (0), (5), (13), (14), (200)) r(c) WHERE c NOT IN (SELECT channel FROM samples)")
def missing_channels(spark, sf):
    return export.missing(samples(spark, sf), [0, 5, 13, 14, 200])


@query("archive_range_scan", "WITH @samples SELECT channel, CAST(count(*) AS BIGINT) n, round(sum(value), 4) total FROM samples WHERE " + _RANGE + " GROUP BY channel")
def archive_range_scan(spark, sf):
    s = samples(spark, sf)
    lo = s.agg(F.min("timestamp_unix_ns")).first()[0] or 0
    d = archive.range_scan(archive.with_date(s), 1001, [0, 1, 2], lo + 86_400_000_000_000, lo + 10 * 86_400_000_000_000)
    return d.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("archive_roundtrip", "WITH @samples SELECT asset, channel, CAST(count(*) AS BIGINT) n, min(timestamp_unix_ns) first_ns, max(timestamp_unix_ns) last_ns, round(sum(value), 4) total FROM samples GROUP BY ALL")
def archive_roundtrip(spark, sf):
    back = archive.roundtrip(samples(spark, sf))
    return back.groupBy(F.col("asset").cast("bigint").alias("asset"), F.col("channel").cast("bigint").alias("channel")).agg(F.count("*").alias("n"), F.min("timestamp_unix_ns").alias("first_ns"), F.max("timestamp_unix_ns").alias("last_ns"), F.round(F.sum("value"), 4).alias("total"))


@query("archive_union", "WITH @samples SELECT event_id, timestamp_unix_ns, round(value, 6) AS value FROM samples")
def archive_union(spark, sf):
    s = samples(spark, sf).select("event_id", "timestamp_unix_ns", F.round("value", 6).alias("value"))
    return s.where("event_id % 2 = 0").unionByName(s.where("event_id % 2 <> 0"))


@query("next_part_index", "SELECT c_nationkey::BIGINT dir, CAST(max(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END) + 1 AS BIGINT) next_index FROM customer GROUP BY c_nationkey HAVING max(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END) IS NOT NULL")
def next_part_index(spark, sf):
    name = F.when(F.col("c_custkey") % 5 == 0, F.lit("notes.txt")).otherwise(F.format_string("part-%04d.parquet", F.col("c_custkey")))
    d = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("dir"), name.alias("name"))
    return archive.next_part_index(d, "dir", "name").where("next_index > 0")


@query("export_day_plan", "SELECT user_id, CAST(strftime(ts + to_days(CAST(u.d AS INTEGER)), '%Y-%m-%d') AS VARCHAR) AS \"day\" FROM events, unnest(range(3)) u(d)")
def export_day_plan(spark, sf):
    d = table(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("a"))
    return export.day_plan(d, F.col("a"), F.col("a") + 2 * 86_400_000_000_000).select("user_id", F.col("day").cast("string").alias("day"))


@query("export_request_parse", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'no channels' WHEN event_id % 7 = 1 THEN 'end before start' WHEN event_id % 7 = 2 THEN 'bad start' WHEN event_id % 7 = 3 THEN 'format' ELSE 'ok' END status,
CASE WHEN event_id % 7 > 3 THEN '0,1,4' END channels, CASE WHEN event_id % 7 > 3 THEN 1761309000000000000::BIGINT END start_ns, CASE WHEN event_id % 7 > 3 THEN 1761309300000000000::BIGINT END end_ns,
CASE WHEN event_id % 7 > 3 THEN 'labjack_asset' || CASE WHEN user_id < 100 THEN lpad(CAST(user_id AS VARCHAR), 3, '0') ELSE CAST(user_id AS VARCHAR) END || '_20251024T123000_20251024T123500.csv' END file_name FROM events""")
def export_request_parse(spark, sf):
    i = F.col("event_id") % 7
    start = F.when(i == 1, "2025-10-24T09:30:00-04:00").when(i == 2, "yesterday").otherwise("2025-10-24T08:30:00-04:00")
    text = F.concat(F.lit('{"asset":'), F.col("user_id").cast("string"), F.lit(',"channels":['), F.when(i == 0, "").otherwise("4,0,1,1"), F.lit('],"start":"'), start, F.lit('","end":"2025-10-24T08:35:00-04:00"'), F.when(i == 3, ',"format":"parquet"').otherwise(""), F.lit("}"))
    return export.parse_request(table(spark, sf, "events").select("event_id", text.alias("request")), "request").drop("request")


@query("csv_signal_load", """WITH x AS (SELECT event_id, user_id % 14 ch, epoch_us(ts) us, value FROM events WHERE event_id % 9 <> 0 AND event_id % 8 <> 0 AND user_id % 14 = 3), m AS (SELECT min(us) m FROM x)
SELECT event_id, round((us - m) / 1e6, 6) t, round(value, 6) v FROM x, m""")
def csv_signal_load(spark, sf):
    from samplewell.operators import series

    s = samples(spark, sf)
    i = F.col("event_id")
    lines = s.select("event_id", F.when(i % 9 == 0, "not a time").otherwise(timefmt.rfc3339(F.col("timestamp_unix_ns"))).alias("timestamp"), keys.padded_channel(F.col("channel")).alias("channel"), F.when(i % 8 == 0, "x").otherwise(F.col("value").cast("string")).alias("raw_value"))
    return series.csv_signal(lines, "ch03", "raw_value").select("event_id", F.round("t", 6).alias("t"), F.round("v", 6).alias("v"))
