"""Conflation and configuration in streams, by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from samplewell.operators import config


def newest(batch: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of each key."""
    others = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*others), time).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def conflate(stream: DataFrame, key: str, time: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch's newest row of each key to sink(rows, batch_id)."""
    return stream.writeStream.foreachBatch(lambda b, n: sink(newest(b, key, time), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_latest_config(stream: DataFrame, read_log: Callable[[], DataFrame], on: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Join each micro-batch with the configuration log as it is when the batch runs (small: one row a key, Spark chooses the join)."""

    def step(batch: DataFrame, n: int) -> None:
        sink(batch.join(config.latest(read_log()).withColumnRenamed("key", on), on, "left"), n)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
