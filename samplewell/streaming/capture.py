"""Captures around triggers in a stream: samples of the pre window are held, those after a trigger are added until its post window ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from samplewell.streaming import trigger_state

STATE = trigger_state.STATE + ", times array<bigint>, values array<double>, open array<bigint>"
OUTPUT = "channel bigint, trigger_ns bigint, timestamp_unix_ns bigint, value double"


def captures(stream: DataFrame, threshold: float, rising: bool = True, pre: int = 0, post: int = 0, single: bool = False) -> DataFrame:
    """(channel, trigger_ns, timestamp_unix_ns, value): the samples of [trigger - pre, trigger + post] of each trigger, each once, when its micro-batch comes.

    State: that of the trigger machine, the samples of the last pre window, and the triggers whose post window is open. Batches must follow each other in time.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, 0, None, [], [], [])
        machine = tuple(None if x is None or pd.isna(x) else x for x in held[:4])
        rows = pd.concat(list(frames)).sort_values("timestamp_unix_ns", kind="stable")
        times, values = rows["timestamp_unix_ns"].to_numpy(np.int64), rows["value"].to_numpy(float)
        machine, found = trigger_state.step(machine, times, values, threshold, rising, pre, post, single)
        all_times, all_values = np.r_[np.asarray(held[4], np.int64), times], np.r_[np.asarray(held[5], float), values]
        out = []
        for t in held[6]:  # open since an earlier batch: what it held then has been given
            a, b = len(held[4]), np.searchsorted(all_times, t + post, "right")
            out.append((t, all_times[a:b], all_values[a:b]))
        for t, _ in found:
            a, b = np.searchsorted(all_times, t - pre, "left"), np.searchsorted(all_times, t + post, "right")
            out.append((t, all_times[a:b], all_values[a:b]))
        last = int(all_times[-1])
        keep = np.searchsorted(all_times, last - pre, "left")
        still = [int(t) for t in [*held[6], *(t for t, _ in found)] if t + post >= last]
        state.update((*machine, all_times[keep:].tolist(), all_values[keep:].tolist(), still))
        yield pd.DataFrame({
            "channel": int(key[0]), "trigger_ns": np.concatenate([np.full(len(x), t, np.int64) for t, x, _ in out]) if out else np.empty(0, np.int64),
            "timestamp_unix_ns": np.concatenate([x for _, x, _ in out]) if out else np.empty(0, np.int64), "value": np.concatenate([v for _, _, v in out]) if out else np.empty(0),
        })

    return stream.select("channel", "timestamp_unix_ns", "value").groupBy("channel").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
