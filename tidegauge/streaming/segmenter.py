"""Count-based segmentation of streams, with the state of each signal kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEGMENT = "signal_id long, seg_id long, ts timestamp, prev_ts timestamp, size int, data array<double>"
STATE = "seg_id long, prev_ts timestamp, ts array<timestamp>, data array<double>"


def cut(signal: int, state: tuple | None, points: pd.DataFrame, size: int) -> tuple[list[tuple], tuple]:
    """Segments that new points complete, and the state after them.

    A full buffer leaves when the next point arrives.
    """
    seg, prev, ts, data = state or (0, None, [], [])
    ts, data, out = list(ts), list(data), []
    for t, v in zip(points["ts"], points["value"], strict=True):
        if len(data) >= size:
            out.append((signal, seg, ts[0], prev, len(data), data))
            seg, prev, ts, data = seg + 1, ts[0], [], []
        ts.append(t)
        data.append(float(v))
    return out, (seg, prev, ts, data)


def segments(points: DataFrame, size: int, idle: str | None = None) -> DataFrame:
    """Segments of a stream of (signal_id, ts, idx, value).

    Arrival order within a trigger is by idx. With ``idle`` (a duration), a signal
    without new points for so long leaves its tail as a short segment; by default
    the tail stays in the state.
    """
    names = [c.split()[0] for c in SEGMENT.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            seg, prev, ts, data = held
            state.remove()
            if data:
                yield pd.DataFrame([(key[0], seg, ts[0], prev, len(data), list(data))], columns=names)
            return
        got = pd.concat(list(frames)).sort_values("idx")
        out, held = cut(key[0], held, got, size)
        state.update(held)
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        if out:
            yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return points.groupBy("signal_id").applyInPandasWithState(step, SEGMENT, STATE, "append", timeout)
