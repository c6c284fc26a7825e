"""Adapters from the driver's tables to this library's tables, and the list of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BASE_NS, INTERVAL_NS = 1704067200000000000, 200000

SAMPLES_SQL = "samples AS (SELECT CAST(1001 AS BIGINT) asset, CAST(user_id % 14 AS BIGINT) channel, epoch_us(ts)*1000 timestamp_unix_ns, value, event_id FROM events)"
SCANS_SQL = f"scans AS (SELECT CAST(label AS BIGINT) channel, vec_id sequence, {BASE_NS} + vec_id*64*{INTERVAL_NS} first_ns, CAST({INTERVAL_NS} AS BIGINT) interval_ns, embedding FROM embeddings)"
KV_SQL = "kv AS (SELECT 'v1.box' || (user_id % 5) || '.src' || (user_id % 14) || '.config' AS \"key\", event_id revision, CASE event_type WHEN 'error' THEN 'DEL' ELSE 'PUT' END op, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) k FROM events)"


def query(name: str, sql: str | None = None):
    """Register a query; sql may begin with WITH parts named by @samples, @scans, @kv."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("@samples", SAMPLES_SQL).replace("@scans", SCANS_SQL).replace("@kv", KV_SQL)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select(F.lit(1001).cast("bigint").alias("asset"), F.pmod("user_id", F.lit(14)).cast("bigint").alias("channel"), ns.alias("timestamp_unix_ns"), "value", "event_id")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").cast("bigint").alias("channel"), F.col("vec_id").alias("sequence"), (F.lit(BASE_NS) + F.col("vec_id") * 64 * INTERVAL_NS).alias("first_sample_unix_ns"),
        F.lit(INTERVAL_NS).cast("bigint").alias("sample_interval_ns"), F.col("embedding").cast("array<double>").alias("values"),
    )


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.concat(F.lit("v1.box"), (F.col("user_id") % 5).cast("string"), F.lit(".src"), (F.col("user_id") % 14).cast("string"), F.lit(".config"))
    return e.select(key.alias("key"), F.col("event_id").alias("revision"), F.when(F.col("event_type") == "error", "DEL").otherwise("PUT").alias("op"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
