"""The trigger machine of one channel as a stateful operator.

States: waiting for pre-buffer, armed, triggered. A sample fires if it crosses the threshold while the pre-buffer reaches back far
enough; in normal mode the next may fire once the post window is over, in single mode none does. Semantics are per sample,
so they don't depend on how samples are cut into batches. Only what the next decision needs is kept: the first time, the last
value, the number of samples (to 2) and the last trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "first_ns bigint, last_value double, seen bigint, trigger_ns bigint"
OUTPUT = "channel bigint, trigger_ns bigint, value double"


def step(state: tuple, times, values, threshold: float, rising: bool, pre: int, post: int, single: bool) -> tuple[tuple, list[tuple[int, float]]]:
    """(first, last, seen, trigger) after the samples, in order of time, and the triggers among them."""
    first, last, seen, trigger = state
    times, values = np.asarray(times, np.int64), np.asarray(values, float)
    if not len(times):
        return state, []
    first = int(times[0]) if first is None else first
    before = np.r_[np.nan if last is None else last, values[:-1]]
    crossed = (before <= threshold) & (values > threshold) if rising else (before >= threshold) & (values < threshold)
    out = []
    for k in np.flatnonzero(crossed & (times - first >= pre)):  # crossings only; a first sample has none before it
        t = int(times[k])
        if trigger is None or (not single and t >= trigger + post):
            trigger = t
            out.append((t, float(values[k])))
    return (first, float(values[-1]), min(2, seen + len(times)), trigger), out


def triggers(stream: DataFrame, threshold: float, rising: bool = True, pre: int = 0, post: int = 0, single: bool = False) -> DataFrame:
    """Triggers of a stream (channel, timestamp_unix_ns, value). Within a batch samples are taken in order of time; batches must follow each other in time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, 0, None)
        held = tuple(None if x is None or pd.isna(x) else x for x in held)
        rows = pd.concat(list(frames)).sort_values("timestamp_unix_ns", kind="stable")
        held, found = step(held, rows["timestamp_unix_ns"], rows["value"], threshold, rising, pre, post, single)
        state.update(held)
        yield pd.DataFrame({"channel": [int(key[0])] * len(found), "trigger_ns": [f[0] for f in found], "value": [f[1] for f in found]})

    return stream.select("channel", "timestamp_unix_ns", "value").groupBy("channel").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
