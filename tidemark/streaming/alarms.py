"""Alarms of vessels that fall silent, when event time passes and not when they report again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "mmsi string, kind string, since double, until double, duration_min double"
STATE = "last double, alarmed boolean"


def silence(last: float | None, alarmed: bool, times: np.ndarray, least_s: float) -> tuple[float, bool, np.ndarray, np.ndarray]:
    """(last, alarmed, starts, ends): state after some reports, and the silences that they end.

    Reports at or before the last one known are old news; the order within a batch doesn't matter.
    """
    times = np.unique(times)
    times = times[times > last] if last is not None else times
    if not len(times):
        return last, alarmed, times, times
    before = np.append(times[:1] if last is None else last, times[:-1])
    over = times - before > least_s
    return float(times[-1]), False, before[over], times[over]


def silent_vessels(reports: DataFrame, threshold_min: float, lateness: str = "1 hour", forget_min: float = 1440.0) -> DataFrame:
    """reports (mmsi, timestamp) as a stream -> alarms.

    `silent`: the watermark is more than the threshold past the vessel's last report, and nothing has come; one row
    a silence. `resumed`: a report ended a silence over the threshold, whether an alarm was given or not, with its
    whole length. A vessel silent for the threshold and `forget_min` more is forgotten (`lost`); its next report
    begins anew. Reports behind the watermark are dropped, repeated ones count once, a null vessel is one of its own.

    State is a time and a flag a vessel. Event-time timers wake it, so it costs nothing while vessels report.
    """
    least = threshold_min * 60

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, alarmed = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            passed = state.getCurrentWatermarkMs() / 1000
            if alarmed or passed > last + least + forget_min * 60:
                state.remove()
                rows = [(key[0], "silent", last, np.nan, np.nan)] * (not alarmed) + [(key[0], "lost", last, np.nan, np.nan)]
            else:
                state.update((last, True))
                state.setTimeoutTimestamp(int((last + least + forget_min * 60) * 1000))
                rows = [(key[0], "silent", last, np.nan, np.nan)]
            yield pd.DataFrame(rows, columns=["mmsi", "kind", "since", "until", "duration_min"])
            return
        times = np.concatenate([np.zeros(0), *(f["at"].to_numpy() for f in frames)])
        last, alarmed, starts, ends = silence(last, alarmed, times, least)
        state.update((last, alarmed))
        due = last + least + (forget_min * 60 if alarmed else 0)
        # a timer must lie ahead of the watermark; one that is due goes off with the next batch
        state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"mmsi": key[0], "kind": "resumed", "since": starts, "until": ends, "duration_min": (ends - starts) / 60})

    # seconds since the epoch, whatever the session's time zone
    timed = reports.select("mmsi", "timestamp", (F.unix_micros("timestamp") / 1e6).alias("at")).withWatermark("timestamp", lateness)
    return timed.groupBy("mmsi").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
