"""Nanosecond time stamps (BIGINT) as dates and RFC 3339 text, and the way back. Nothing goes through microsecond types but whole seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def floor_div(x: Column, by: int) -> Column:
    """Floor of x / by for BIGINT x and positive by, in integer arithmetic: a DOUBLE quotient rounds up just below a multiple."""
    return F.call_function("div", x, F.lit(by)) - F.when(x % F.lit(by) < 0, F.lit(1)).otherwise(F.lit(0))


def whole_seconds(ns: Column) -> Column:
    """Floor of ns / 1e9."""
    return floor_div(ns, NS)


def utc_date(ns: Column) -> Column:
    """UTC calendar date; floors, so times before 1970 fall on the right day, and the last nanosecond of a day on that day."""
    return F.to_date(F.timestamp_seconds(whole_seconds(ns)))


def rfc3339(ns: Column) -> Column:
    """`2026-04-22T20:45:00.000075+00:00`: 0, 3, 6 or 9 digits of fraction, as few as tell the time exactly."""
    rest = F.pmod(ns, F.lit(NS))
    digits = F.lpad(rest.cast("string"), 9, "0")
    fraction = (
        F.when(rest == 0, F.lit(""))
        .when(rest % 1_000_000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3)))
        .when(rest % 1_000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 6)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    seconds = F.timestamp_seconds(whole_seconds(ns))
    return F.concat(F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def parse_rfc3339(text: Column) -> Column:
    """Nanoseconds of RFC 3339 text with any offset; null if it is malformed or beyond what BIGINT holds (1677 to 2262). Digits beyond the ninth are dropped."""
    plain = F.regexp_replace(text, r"\.[0-9]+", "")
    well = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]+)", 1), 1, 9), 9, "0").cast("bigint")
    seconds = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(F.upper(plain), "Z$", "+00:00")))
    return F.when(well, (seconds.cast("decimal(20,0)") * F.lit(NS).cast("decimal(10,0)") + fraction.cast("decimal(9,0)")).try_cast("bigint"))


def float_text(x: Column) -> Column:
    """Shortest round-trip digits without an exponent, `2` for 2.0, `NaN`, `inf`, `-inf`."""
    s = x.cast("string")
    mantissa, power = F.substring_index(s, "E", 1), F.substring_index(s, "E", -1).cast("int")
    sign = F.when(F.startswith(s, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_replace(F.substring_index(mantissa, ".", 1), "-", "")
    part = F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits = F.concat(whole, part)
    up = F.when(power >= F.length(part), F.rpad(digits, (power + 1).cast("int"), F.lit("0"))).otherwise(
        F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2, F.length(digits)))
    )
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.regexp_replace(s, r"\.0$", "")
    return (
        F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
        .when(~F.contains(s, F.lit("E")), plain).when(power > 0, F.concat(sign, up)).otherwise(F.concat(sign, down))
    )
