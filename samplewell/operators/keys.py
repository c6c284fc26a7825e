"""Routing keys: sanitized tokens, subjects, patterns, config keys, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize(text: Column, collapse_runs: bool = False) -> Column:
    """Lower-case token of [a-z0-9_-]: white space, `.` and `/` become `-` (a run becomes one with collapse_runs), the rest goes, outer `-` too; empty is `unknown`."""
    s = F.regexp_replace(F.trim(text), r"[\s./]+" if collapse_runs else r"[\s./]", "-")
    s = F.regexp_replace(F.lower(F.regexp_replace(s, "[^A-Za-z0-9_-]", "")), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def sanitize_calibration_id(text: Column) -> Column:
    """Lower case, runs of white space become `-`, then only [a-z0-9._-] stays."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-"), "[^a-z0-9._-]", "")


def padded_channel(channel: Column) -> Column:
    return F.concat(F.lit("ch"), F.when(channel < 10, F.lpad(channel.cast("string"), 2, "0")).otherwise(channel.cast("string")))


def padded_asset(asset: Column) -> Column:
    return F.when(asset < 100, F.lpad(asset.cast("string"), 3, "0")).otherwise(asset.cast("string"))


def set_(text: Column) -> Column:
    """The text, or null if it is empty: empty ids count as not set."""
    return F.nullif(F.trim(text), F.lit(""))


#: The root of new-scheme subjects, unless a call names another.
ROOT = "plant"


def is_v1(subject: Column, box: Column, source: Column, root: str = ROOT) -> Column:
    """Whether a device's subjects follow the new scheme: by its root, or since a box or source is named."""
    return (subject == root) | set_(box).isNotNull() | set_(source).isNotNull()


def source_token(source: Column, name: Column, asset: Column) -> Column:
    return sanitize(F.coalesce(set_(source), set_(name), F.concat(F.lit("asset"), padded_asset(asset))))


def channel_subject(subject: Column, asset: Column, channel: Column, box: Column, source: Column, name: Column, root: str = ROOT) -> Column:
    """`{root}.v1.{box}.{source}.{ch}` in the new scheme, `{root}.{asset}.data.{ch}` in the old."""
    new = F.concat_ws(".", sanitize(subject), F.lit("v1"), sanitize(F.coalesce(set_(box), F.lit("unknown-box"))), source_token(source, name, asset), padded_channel(channel))
    return F.when(is_v1(subject, box, source, root), new).otherwise(F.concat_ws(".", subject, padded_asset(asset), F.lit("data"), padded_channel(channel)))


def stream_pattern(subject: Column, box: Column, source: Column, name: Column, root: str = ROOT) -> Column:
    """What a device's stream subscribes to: all its channels in the new scheme, all assets' channels in the old."""
    new = F.concat_ws(".", sanitize(subject), F.lit("v1"), sanitize(F.coalesce(set_(box), F.lit("unknown-box"))), sanitize(F.coalesce(set_(source), set_(name), F.lit("unknown-source"))), F.lit("*"))
    return F.when(is_v1(subject, box, source, root), new).otherwise(F.concat(subject, F.lit(".*.data.*")))


def compatible(existing: Column, wanted: Column) -> Column:
    """Equal, or an old-scheme pattern of one asset under the wanted pattern of all assets."""
    prefix = F.regexp_replace(wanted, r"\.\*\.data\.\*$", ".")
    return (existing == wanted) | (F.endswith(wanted, F.lit(".*.data.*")) & F.startswith(existing, prefix) & F.endswith(existing, F.lit(".data.*")))


def export_subjects(prefix: Column, box: Column, job: Column) -> tuple[Column, Column]:
    """(request, reply): where a box's exporter takes requests, and where the frames of one job go."""
    base = F.regexp_replace(prefix, r"\.+$", "")
    return F.concat_ws(".", base, F.lit("request"), sanitize(box)), F.concat_ws(".", base, F.lit("reply"), sanitize(job))


def last_token(subject: Column) -> Column:
    return F.element_at(F.split(subject, r"\."), -1)


def config_key(box: Column, source: Column) -> Column:
    return F.concat_ws(".", F.lit("v1"), sanitize(box), sanitize(source), F.lit("config"))


def consumer_name(box: Column, kind: Column, source: Column, channel: Column) -> Column:
    return F.concat_ws("-", F.lit("archiver"), sanitize(box), sanitize(kind), sanitize(source), channel.cast("string"))


def servers(text: Column) -> Column:
    """Comma-separated servers, trimmed, empty ones dropped, the leaf port 7422 replaced by the client port 4222."""
    parts = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, ":7422$", ":4222"))


def websocket_servers(text: Column, secure: bool = False) -> Column:
    """Candidates for a websocket server: http becomes ws and https wss, a closing slash goes; without a scheme that of the page first, then the other. None for blank text."""
    t, scheme = F.trim(text), "^[A-Za-z][A-Za-z0-9+.-]*://"
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "/$", ""), "^(?i)http://", "ws://"), "^(?i)https://", "wss://")
    both = [F.concat(F.lit(s), plain) for s in (("wss://", "ws://") if secure else ("ws://", "wss://"))]
    return F.when(t == "", F.array().cast("array<string>")).when(t.rlike(scheme), F.array(plain)).otherwise(F.array(*both))


def matches(subject: Column, pattern: str) -> Column:
    """Whether a subject fits a pattern: `*` is one token, a last `>` is one or more."""
    tokens = pattern.split(".")
    parts = ["[^.]+" if t == "*" else ".+" if t == ">" and k == len(tokens) - 1 else re.sub(r"([^A-Za-z0-9_-])", r"\\\1", t) for k, t in enumerate(tokens)]
    return subject.rlike("^" + r"\.".join(parts) + "$")


def ipv4(n: Column) -> Column:
    """Dotted address of a 32-bit number, negative or not; null for 0."""
    byte = [F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]
    return F.when(n != 0, F.concat_ws(".", *byte))


def bytes_text(n: Column) -> Column:
    """Steps of 1024: whole bytes, one decimal from KB on."""
    x = n.cast("double")
    out = F.when(x < 1024, F.concat(F.format_string("%.0f", x), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        part = F.concat(F.format_string("%.1f", x / 1024.0**k), F.lit(f" {unit}"))
        out = out.when(x < 1024.0 ** (k + 1), part) if unit != "GB" else out.otherwise(part)
    return out


def latency_ms(received_ns: Column, source_ns: Column) -> Column:
    """Whole milliseconds from a message's source time to its receipt; clocks that disagree give 0."""
    return F.call_function("div", F.greatest(F.lit(0).cast("bigint"), received_ns - source_ns), F.lit(1_000_000))


def lag_text(ms: Column) -> Column:
    """Whole milliseconds, seconds, minutes or hours; `--` for what is negative or not finite."""
    x = ms.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")), F.lit("--")).when(x < 1000, F.format_string("%dms", F.floor(x + 0.5)))
        .when(x < 60_000, F.format_string("%.2fs", x / 1000)).when(x < 3_600_000, F.format_string("%.1fm", x / 60_000)).otherwise(F.format_string("%.2fh", x / 3_600_000))
    )
