"""Runs of a live stream of occurrences, for later batch matching.

State holds one open run an arc. A snapshot that follows it extends it, one beyond a gap closes it,
and the watermark closes what hasn't been extended in time. Closed runs are appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "src long, dst long, start int, end int"


def bucketed(rows: DataFrame, ts: str, minutes: int, watermark: str) -> DataFrame:
    """Distinct occurrences (src, dst, t, at) of a stream with timestamps, late rows dropped."""
    width = minutes * 60
    t = F.floor(F.unix_timestamp(ts) / width).cast("int")
    return rows.withWatermark(ts, watermark).select("src", "dst", t.alias("t"), F.col(ts).alias("at"))


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState, width: int, patience: int) -> Iterator[pd.DataFrame]:
    start, end = state.get if state.exists else (None, None)
    closed = []
    if state.hasTimedOut:
        closed.append((start, end))
        state.remove()
    else:
        times = sorted({int(t) for f in frames for t in f["t"]})
        for t in times:
            if start is None:
                start = end = t
            elif t > end + 1:
                closed.append((start, end))
                start = end = t
            elif t > end:
                end = t
            elif t == start - 1:
                start = t
        state.update((start, end))
        due = (end + 2 + patience) * width * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([(*key, a, b) for a, b in closed], columns=["src", "dst", "start", "end"])


def live_runs(occurrences: DataFrame, minutes: int, patience: int = 0) -> DataFrame:
    """Closed runs (src, dst, start, end) of a stream made by :func:`bucketed`.

    A run stays open for ``patience`` snapshots beyond the one that could extend it.
    """

    def step(key, frames, state):
        return _advance(key, frames, state, minutes * 60, patience)

    return occurrences.groupBy("src", "dst").applyInPandasWithState(step, OUT, "start int, end int", "append", GroupStateTimeout.EventTimeTimeout)
