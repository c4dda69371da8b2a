"""Strikes over a stream of observations, as ``liveness.strikes`` over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.liveness import STRIKE_SPACING

STRUCK = "key long, at long, seen string, strikes int, verdict string, alert boolean"
STATE = "first long, last_at long, last_seen string, waiting_at array<long>, waiting_seen array<string>"
COLUMNS = ["key", "at", "seen", "strikes", "verdict", "alert"]


def strikes_stream(observations: DataFrame, lateness: str = "2 hours", idle: int = 30 * 24 * 60) -> DataFrame:
    """``strikes`` of a stream of observations (key, at: minutes since 1970, seen).

    Rows wait in a key's state until the watermark has passed them, so rows that
    come late by less than ``lateness`` take their place, and the stream gives
    what the batch gives; later ones are dropped by the watermark. A key that
    hasn't been seen for ``idle`` minutes leaves no state behind.
    """
    timed = observations.withColumn("time", F.timestamp_seconds(F.col("at") * 60)).withWatermark("time", lateness)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last_at, last_seen, at, seen = state.get if state.exists else (None, None, None, [], [])
        passed = state.getCurrentWatermarkMs() // 60_000
        waiting = list(zip(at, seen))
        for frame in frames:
            waiting += zip(frame["at"].astype(int), frame["seen"])
        ready, waiting = sorted(x for x in waiting if x[0] < passed), [x for x in waiting if x[0] >= passed]
        rows = []
        for at, seen in ready:
            if last_at is not None and at <= last_at:
                continue
            n = 0
            first = (at if first is None else first) if seen == "absent" else None
            if seen == "absent":
                n = 1 if at - first < STRIKE_SPACING else 2
            verdict = "alive" if seen == "present" else ("unknown", "pending", "confirm")[n]
            rows.append((key[0], at, seen, n, verdict, seen == "unknown" and last_seen != "unknown"))
            last_at, last_seen = at, seen
        if not waiting and last_at is not None and last_at + idle < passed:
            state.remove()
        else:
            state.update((first, last_at, last_seen, [w[0] for w in waiting], [w[1] for w in waiting]))
            due = min((w[0] for w in waiting), default=(last_at or passed) + idle)
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (due + 1) * 60_000))
        yield pd.DataFrame(rows, columns=COLUMNS)

    return timed.groupBy("key").applyInPandasWithState(fold, STRUCK, STATE, "append", "EventTimeTimeout")
