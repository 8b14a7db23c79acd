"""Gap filling on an unbounded stream of rows.

Row windows are not allowed on streams, so each series keeps its last valid row and the
positions that wait for the next one. Rows of a series must arrive in order of position,
as a recorder sends them; within a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "video string, frame_idx long, value double, is_interpolated boolean"
STATE = "last_idx long, last_value double, waiting array<long>"


def _fill(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    last, value, waiting = state.get if state.exists else (None, None, [])
    waiting, out = list(waiting), []
    if state.hasTimedOut:
        if value is not None:
            # nothing followed: the last valid value continues
            yield pd.DataFrame([(key[0], i, value, True) for i in waiting], columns=["video", "frame_idx", "value", "is_interpolated"])
        state.remove()
        return
    for i, v in pd.concat(list(batches)).sort_values("frame_idx")[["frame_idx", "value"]].itertuples(index=False):
        if pd.isna(v):
            waiting.append(int(i))
            continue
        for w in waiting:
            out.append((key[0], w, v if last is None else value + (v - value) * (w - last) / (i - last), True))
        out.append((key[0], int(i), float(v), False))
        last, value, waiting = int(i), float(v), []
    state.update((last, value, waiting))
    state.setTimeoutDuration(idle_ms)
    if out:
        yield pd.DataFrame(out, columns=["video", "frame_idx", "value", "is_interpolated"])


def fill_gaps(rows: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """``video, frame_idx, value, is_interpolated`` of a stream of ``video, frame_idx, value``.

    A row without a value comes out once a valid one follows, interpolated linearly, or flat
    before the first. A series that is idle for ``idle_ms`` ends: what waits is filled flat
    with its last value, and its state is dropped; without any valid row nothing comes out.
    Waiting for that keeps a query running on batches without data; one that should end with
    its input (``availableNow``) needs spark.sql.streaming.noDataMicroBatches.enabled=false.
    """
    return (
        rows.select("video", "frame_idx", "value").groupBy("video")
        .applyInPandasWithState(lambda k, b, s: _fill(k, b, s, idle_ms), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    )
