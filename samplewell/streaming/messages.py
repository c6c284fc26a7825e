"""Between devices, message streams and text: batches in, messages out, and a readable copy by channel."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from samplewell.operators import keys, scans
from samplewell.sources import wire


def per_channel(batches: DataFrame, channels: list[int]) -> DataFrame:
    """Interleaved batches (sequence, first_sample_unix_ns, sample_interval_ns, actual_scan_rate_hz, values) as one row per channel with its values in order; ragged and empty batches are dropped."""
    n = len(channels)
    ok = batches.where(scans.batch_status(F.col("values"), F.lit(n)) == "ok")
    own = F.array(*[F.struct(F.lit(c).cast("bigint").alias("channel"), F.filter("values", _every(n, k)).alias("values")) for k, c in enumerate(channels)])
    return ok.withColumn("c", F.explode(own)).drop("values").select("*", "c.channel", "c.values").drop("c")


def _every(n: int, k: int):
    return lambda x, i: F.pmod(i, F.lit(n)) == k


def encoded(rows: DataFrame, subject: str = "subject") -> DataFrame:
    """Rows of per_channel with a subject as (subject, payload): messages ready to publish."""
    cols = ["first_sample_unix_ns", "sample_interval_ns", "actual_scan_rate_hz", "sequence", "values"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data = [wire.encode(*r) for r in zip(*(b.column(c).to_pylist() for c in cols))]
            yield pa.RecordBatch.from_arrays([b.column(subject), pa.array(data, pa.binary())], names=["subject", "payload"])

    return rows.select(subject, *cols).mapInArrow(run, T.StructType([T.StructField("subject", T.StringType()), T.StructField("payload", T.BinaryType())]))


def publish(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append messages (subject, payload) to a log of files that consumers read as a stream."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The messages (subject, payload) of a log whose subject fits a pattern, as a stream. A consumer's progress is its checkpoint: one of its own makes it durable, a new one begins anew."""
    return spark.readStream.schema("subject string, payload binary").parquet(path).where(keys.matches(F.col("subject"), pattern))


def supervised(start: Callable[[], StreamingQuery], stopped: Callable[[], bool], pause: float = 5.0, wait: Callable[[float], None] = time.sleep) -> None:
    """Keep a query going: when it fails, it is started again after a pause, from its checkpoint, until it ends by itself or stopped() says so."""
    while not stopped():
        try:
            start().awaitTermination()
            return
        except StreamingQueryException:
            if not stopped():
                wait(pause)


def append_text(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A readable copy of messages (subject, payload): sequence, timestamp and raw value as CSV with a header, in a folder for each channel token."""
    rows = scans.expand(wire.decode_messages(messages)).select(keys.last_token(F.col("subject")).alias("channel"), "sequence", F.col("timestamp_unix_ns").alias("timestamp"), F.col("value").alias("raw_value"))

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").partitionBy("channel").option("header", "true").csv(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
