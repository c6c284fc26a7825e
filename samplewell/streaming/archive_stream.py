"""Continuous ingest: message files or any stream of payloads to the partitioned archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from samplewell.operators import scans
from samplewell.sources import archive, wire


def samples(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Stream or table of (asset, channel, payload) as samples with their date; bad payloads and times out of range are dropped."""
    return archive.with_date(scans.expand(wire.decode_messages(messages, payload))).select("asset", "date", "channel", "timestamp_unix_ns", "value")


def start(messages: DataFrame, path: str, checkpoint: str, rotate_secs: int | None = None) -> StreamingQuery:
    """Write the archive; files are committed once for each trigger, so a restart neither loses nor repeats samples. Without rotate_secs all that is there is taken and the query ends."""
    trigger = {"availableNow": True} if rotate_secs is None else {"processingTime": f"{rotate_secs} seconds"}
    return samples(messages).writeStream.format("parquet").partitionBy("asset", "date", "channel").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
