"""Device configurations: parsing, defaults, validation, comparison; and the key-value change log they live in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplewell.operators import keys

#: The field names of a device configuration.
SENSOR = "scans_per_read:int,scan_rate:int,scan_rate_hz:double,sampling_rate:double,channels_enabled:array<int>,gains:int,data_formats:array<string>,measurement_units:array<string>,labjack_on_off:boolean"
SCHEMA = f"labjack_name string, asset_number int, max_channels int, site_id string, box_id string, source_type string, source_id string, nats_subject string, nats_stream string, rotate_secs bigint, sensor_settings struct<{SENSOR}>"
#: The required keys of an edge box configuration.
REQUIRED = (
    "site_id", "box_id", "source.type", "source.id", "nats.root_subject", "nats.local_servers", "nats.leaf_server_name", "nats.leaf_listen", "nats.monitor_listen",
    "nats.jetstream_domain", "nats.jetstream_store_dir", "nats.leaf_credentials_path", "nats.kv_bucket", "nats.kv_key", "nats.stream_name", "paths.rust_creds_file",
    "paths.output_dir", "paths.parquet_dir", "paths.exporter_http_url", "labjack.name", "labjack.asset_number", "labjack.max_channels", "labjack.ip", "labjack.serial",
    "labjack.rotate_secs", "labjack.sensor_settings.scans_per_read", "labjack.sensor_settings.scan_rate_hz",
)
#: Fields of a device configuration and where an edge box configuration has them.
OF_BOX = (
    ("labjack_name", "labjack.name"), ("asset_number", "labjack.asset_number"), ("max_channels", "labjack.max_channels"), ("site_id", "site_id"), ("box_id", "box_id"), ("source_type", "source.type"),
    ("source_id", "source.id"), ("nats_subject", "nats.root_subject"), ("nats_stream", "nats.stream_name"), ("rotate_secs", "labjack.rotate_secs"), ("sensor_settings", "labjack.sensor_settings"),
)
#: Settings of the streamer and of the archiver and where an edge box configuration has them; some have a default.
STREAMER = (
    ("NATS_SUBJECT", "nats.root_subject"), ("NATS_SERVERS", "nats.local_servers"), ("JS_DOMAIN", "nats.jetstream_domain"), ("ASSET_NUMBER", "labjack.asset_number"), ("SITE_ID", "site_id"), ("BOX_ID", "box_id"),
    ("SOURCE_TYPE", "source.type"), ("SOURCE_ID", "source.id"), ("OUTPUT_DIR", "paths.output_dir"), ("NATS_CREDS_FILE", "paths.rust_creds_file"), ("CFG_BUCKET", "nats.kv_bucket"), ("CFG_KEY", "nats.kv_key"),
    ("CENTRAL_NATS_CREDS_FILE", "paths.rust_creds_file"), ("CENTRAL_CFG_BUCKET", "nats.kv_bucket"), ("CENTRAL_CFG_KEY", "nats.kv_key"), ("LABJACK_IDENTIFIER", "labjack.identifier", ""), ("LABJACK_SERIAL", "labjack.serial"),
    ("LABJACK_NAME", "labjack.name"), ("LABJACK_IP", "labjack.ip"), ("LABJACK_USB_ID", "labjack.usb_id", "ANY"), ("LABJACK_OPEN_ORDER", "labjack.open_order", "ethernet"), ("EXPORTER_HTTP_URL", "paths.exporter_http_url"),
    ("STREAM_MAX_BYTES", "nats.stream_max_bytes"),
)
ARCHIVER = (
    ("NATS_SUBJECT", "nats.root_subject"), ("NATS_SERVERS", "nats.local_servers"), ("JS_DOMAIN", "nats.jetstream_domain"), ("SITE_ID", "site_id"), ("BOX_ID", "box_id"), ("SOURCE_TYPE", "source.type"),
    ("SOURCE_ID", "source.id"), ("NATS_CREDS_FILE", "paths.rust_creds_file"), ("CFG_BUCKET", "nats.kv_bucket"), ("CFG_KEY", "nats.kv_key"), ("PARQUET_DIR", "paths.parquet_dir"),
)


def parse(text: Column) -> Column:
    """The configuration as a struct with the old field names folded in; null if a required field is missing or the text is no such JSON."""
    c = F.from_json(text, SCHEMA)
    s = c["sensor_settings"]
    scans, rate = F.coalesce(s["scans_per_read"], s["scan_rate"]), F.coalesce(s["scan_rate_hz"], s["sampling_rate"])
    needed = [c[x] for x in ("labjack_name", "asset_number", "max_channels", "nats_subject", "nats_stream", "rotate_secs")] + [scans, rate, s["channels_enabled"]]
    ok = needed[0].isNotNull()
    for n in needed[1:]:
        ok &= n.isNotNull()
    return F.when(ok, F.struct(c["labjack_name"].alias("labjack_name"), c["asset_number"].alias("asset_number"), c["rotate_secs"].alias("rotate_secs"), scans.alias("scans_per_read"), rate.alias("scan_rate_hz"), s["channels_enabled"].alias("channels_enabled")))


def with_defaults(text: Column) -> Column:
    """Every field, defaults where the text has none; formats and units are padded to the number of channels."""
    c = F.from_json(text, SCHEMA)
    s = c["sensor_settings"]
    channels = F.coalesce(s["channels_enabled"], F.array().cast("array<int>"))

    def padded(a: Column, fill: str) -> Column:
        a = F.coalesce(a, F.array().cast("array<string>"))
        return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.size(channels) - F.size(a), F.lit(0))))

    d = lambda x, v, n: F.coalesce(x, F.lit(v)).alias(n)
    return F.struct(
        d(c["labjack_name"], "unknown", "labjack_name"), d(c["asset_number"], 0, "asset_number"), d(c["max_channels"], 8, "max_channels"), d(c["site_id"], "", "site_id"), d(c["box_id"], "", "box_id"),
        d(c["source_type"], "labjack", "source_type"), F.coalesce(c["source_id"], c["labjack_name"], F.lit("")).alias("source_id"), d(c["nats_subject"], keys.ROOT, "nats_subject"), d(c["nats_stream"], "labjacks", "nats_stream"),
        d(c["rotate_secs"], 60, "rotate_secs"), F.coalesce(s["scans_per_read"], s["scan_rate"], F.lit(200)).alias("scans_per_read"), F.coalesce(s["scan_rate_hz"], s["sampling_rate"], F.lit(1000.0)).alias("scan_rate_hz"),
        channels.alias("channels_enabled"), d(s["gains"], 1, "gains"), padded(s["data_formats"], "voltage").alias("data_formats"), padded(s["measurement_units"], "V").alias("measurement_units"), d(s["labjack_on_off"], False, "labjack_on_off"),
    )


def errors(c, name_taken: Column, asset_taken: Column) -> Column:
    """Names of the fields that break a rule, in the order of the rules. c: function from a field's name to its column."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    n = F.size(c("channels_enabled"))
    rules = [
        ("labjack_name", blank(c("labjack_name")) | name_taken), ("asset_number", (c("asset_number") <= 0) | asset_taken), ("max_channels", (c("max_channels") <= 0) | (c("max_channels") > 16)),
        ("rotate_secs", c("rotate_secs") <= 0), ("nats_subject", blank(c("nats_subject"))), ("nats_stream", blank(c("nats_stream"))), ("scans_per_read", c("scans_per_read") <= 0),
        ("scan_rate_hz", c("scan_rate_hz") <= 0), ("channels_enabled", n == 0), ("gains", c("gains") <= 0), ("data_formats", F.size(c("data_formats")) != n), ("measurement_units", F.size(c("measurement_units")) != n),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))


def missing_keys(text: Column, required=REQUIRED) -> Column:
    """Required dotted keys that are absent, null or empty."""
    value = [F.get_json_object(text, f"$.{k}") for k in required]
    return F.array_compact(F.array(*[F.when(v.isNull() | v.isin("", "null"), F.lit(k)) for k, v in zip(required, value)]))


def latest(log: DataFrame, key: str = "key", revision: str = "revision") -> DataFrame:
    """The last revision of each key; a key whose last operation is no PUT is gone."""
    others = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*others), revision).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in others]).where("op = 'PUT'")


def history(log: DataFrame, keep: int = 5) -> DataFrame:
    """The last `keep` revisions of each key, numbered from the newest."""
    w = Window.partitionBy("key").orderBy(F.desc("revision"))
    return log.withColumn("age", F.row_number().over(w).cast("bigint")).where(F.col("age") <= keep)


def changes(log: DataFrame, value: str) -> DataFrame:
    """PUTs whose value differs from the PUT before it of the same key."""
    puts = log.where("op = 'PUT'")
    w = Window.partitionBy("key").orderBy("revision")
    return puts.withColumn("previous", F.lag(value).over(w)).withColumn("nth", F.row_number().over(w)).where((F.col("nth") == 1) | ~F.col("previous").eqNullSafe(F.col(value))).drop("nth", "previous")


def mirror_diff(remote: DataFrame, local: DataFrame, key: str, value: str) -> DataFrame:
    """Remote entries that the local copy lacks or has otherwise."""
    r, l = remote.alias("r"), local.select(F.col(key).alias("lk"), F.col(value).alias("lv")).alias("l")
    return r.join(l, F.col(key) == F.col("lk"), "left").where(~F.col(value).eqNullSafe(F.col("lv"))).drop("lk", "lv")


def channel_diff(old: DataFrame, new: DataFrame, key: str, channel: str) -> DataFrame:
    """`added`, `removed` or `kept` for each channel of either side."""
    o, n = old.select(key, channel).distinct().withColumn("o", F.lit(1)), new.select(key, channel).distinct().withColumn("n", F.lit(1))
    return o.join(n, [key, channel], "full_outer").withColumn("change", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept")).drop("o", "n")


def merged(defaults: list[tuple[str, float]], overrides: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Each key's defaults with its overrides (key, name or null, value), for the keys of overrides."""
    items = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(v).alias("v")) for n, v in defaults])
    base = overrides.select(key).distinct().withColumn("d", F.explode(items)).select(key, F.col("d.n").alias(name), F.col("d.v").alias("default_value"))
    return base.join(overrides.where(F.col(name).isNotNull()), [key, name], "full_outer").select(key, name, F.coalesce(value, "default_value").alias(value))


def first_match(df: DataFrame, key: str, name: str, preferred: Column) -> DataFrame:
    """(key, name): each key's first name in order, those that are preferred before the others."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct((~F.coalesce(preferred, F.lit(False))).alias("other"), F.col(name).alias("name"))).alias("m")).select(key, F.col("m.name").alias(name))


def zipped(channels: Column, **lists: Column) -> Column:
    """Array of (channel, ...) in order of channel: entry i of each list belongs to channel i of the list of channels; short lists give nulls."""
    return F.array_sort(F.arrays_zip(channels.alias("channel"), *[x.alias(n) for n, x in lists.items()]))


def toggled(channels: Column, channel: Column, **lists: tuple[Column, Column]) -> Column:
    """zipped(channels, ...) without the channel, or, if it isn't among them, with it; name=(list, value for a new channel)."""
    pairs = zipped(channels, **{n: x for n, (x, _) in lists.items()})
    more = zipped(F.concat(channels, F.array(channel)), **{n: F.concat(F.slice(F.concat(x, F.array_repeat(F.lit(None), F.size(channels))), F.lit(1), F.size(channels)), F.array(v)) for n, (x, v) in lists.items()})
    return F.when(F.array_contains(channels, channel), F.filter(pairs, lambda p: p["channel"] != channel)).otherwise(more)


def parse_channels(text: Column) -> Column:
    """Channel numbers of a comma-separated list, blank parts dropped; null if a part is no number, or negative, or none is left."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("int"))
    return F.when((F.size(parts) > 0) & F.forall(numbers, lambda n: n.isNotNull() & (n >= 0)), numbers)


def change_kinds(log: DataFrame, device: list[Column], calibration: list[Column], key: str = "key", revision: str = "revision") -> DataFrame:
    """The PUTs with kind: `added` (a key's first), `respawn` (a device column differs from the PUT before), `recalibrate` (only a calibration column does) or `none`."""
    w = Window.partitionBy(key).orderBy(revision)
    puts = log.where("op = 'PUT'").withColumn("_own", F.struct(F.struct(*[c.alias(f"d{k}") for k, c in enumerate(device)]).alias("d"), F.struct(*[c.alias(f"c{k}") for k, c in enumerate(calibration)]).alias("c")))
    puts = puts.withColumn("_last", F.lag("_own").over(w))
    differs = lambda part: ~F.col(f"_own.{part}").eqNullSafe(F.col(f"_last.{part}"))
    return puts.withColumn("kind", F.when(F.col("_last").isNull(), "added").when(differs("d"), "respawn").when(differs("c"), "recalibrate").otherwise("none")).drop("_own", "_last")


def with_runs(log: DataFrame, device: list[Column], calibration: list[Column], key: str = "key", revision: str = "revision") -> DataFrame:
    """change_kinds with run_id: the number of the device's run, which a first configuration and each respawn begin; sequences start at 0 in each."""
    kinds = change_kinds(log, device, calibration, key, revision)
    w = Window.partitionBy(key).orderBy(revision).rowsBetween(Window.unboundedPreceding, 0)
    return kinds.withColumn("run_id", F.sum(F.col("kind").isin("added", "respawn").cast("bigint")).over(w) - 1)


def cascaded(df: DataFrame, defaults: str, own: str, schema: str) -> DataFrame:
    """The fields of a JSON object, each from column `own` or else from column `defaults`, beside the other columns."""
    names = [f.split()[0] for f in schema.split(", ")]
    d = df.withColumn("_own", F.from_json(F.col(own), schema)).withColumn("_default", F.from_json(F.col(defaults), schema))
    return d.select(*[c for c in df.columns if c not in (defaults, own)], *[F.coalesce(F.col(f"_own.{n}"), F.col(f"_default.{n}")).alias(n) for n in names])


def device_of_box(text: Column) -> Column:
    """The device configuration (JSON) that an edge box configuration holds; fields that it lacks are left out."""
    field = lambda name, path: F.when(F.get_json_object(text, f"$.{path}").isNotNull(), F.concat(F.lit(f'"{name}":'), _json_of(text, path)))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[field(*x) for x in OF_BOX])), ","), F.lit("}"))


def _json_of(text: Column, path: str) -> Column:
    """A value of JSON text as JSON: strings in quotes, the rest as it stands."""
    value = F.get_json_object(text, f"$.{path}")
    *outer, last = path.split(".")
    inside = F.get_json_object(text, "$" + "".join(f".{x}" for x in outer)) if outer else text
    quoted = F.regexp_extract(inside, rf'"{last}"\s*:\s*(")', 1) == '"'
    return F.when(quoted, F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(value)


def environment(text: Column, names=STREAMER) -> Column:
    """Map of setting -> text for a service of an edge box; settings that the configuration lacks and that have no default are left out."""
    entries = [F.struct(F.lit(n).alias("key"), F.coalesce(F.get_json_object(text, f"$.{p}"), *map(F.lit, default)).alias("value")) for n, p, *default in names]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def central_servers(text: Column) -> Column:
    """Comma-separated client servers of the centre: as configured (text or list), else the leaf remotes with the client port."""
    def listed(path: str) -> Column:
        return F.filter(F.transform(F.from_json(F.get_json_object(text, path), "array<string>"), lambda x: F.trim(x)), lambda x: x != "")

    own, remotes = F.get_json_object(text, "$.nats.central_servers"), listed("$.nats.leaf_remotes")
    several = F.when(own.startswith("["), F.nullif(F.array_join(listed("$.nats.central_servers"), ","), F.lit("")))
    one = F.when(~own.startswith("["), F.nullif(F.trim(own), F.lit("")))
    derived = F.array_join(F.transform(remotes, lambda r: F.regexp_replace(r, ":7422$", ":4222")), ",")
    return F.coalesce(one, several, derived, F.lit(""))
