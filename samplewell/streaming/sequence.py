"""Continuity of message sequences over micro-batches: the last sequence of each channel is the state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "channel bigint, run_id bigint, sequence bigint, state string, missing bigint"


def states(last: int | None, sequences: np.ndarray) -> tuple[list[str], np.ndarray]:
    """`first`, `ok` (previous + 1), `gap` (more) or `reset` (not more) of each sequence, and how many are missing before it."""
    step = np.diff(sequences, prepend=sequences[0] if last is None else last)
    kinds = np.where(step == 1, "ok", np.where(step > 1, "gap", "reset")).astype(object)
    missing = np.where(step > 1, step - 1, 0)
    if last is None:
        kinds[0], missing[0] = "first", 0
    return kinds.tolist(), missing


def continuity(stream: DataFrame) -> DataFrame:
    """States of a stream (channel, run_id, arrival, sequence): within a micro-batch messages go by arrival, then by sequence. A new run of a device begins anew, as does its state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["arrival", "sequence"], kind="stable")
        sequences = rows["sequence"].to_numpy(np.int64)
        kinds, missing = states(state.get[0] if state.exists else None, sequences)
        state.update((int(sequences[-1]),))
        yield pd.DataFrame({"channel": int(key[0]), "run_id": int(key[1]), "sequence": sequences, "state": kinds, "missing": missing})

    return stream.select("channel", "run_id", "arrival", "sequence").groupBy("channel", "run_id").applyInPandasWithState(run, OUTPUT, "last bigint", "append", GroupStateTimeout.NoTimeout)
