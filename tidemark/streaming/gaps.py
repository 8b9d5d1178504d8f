"""Silent vessels as they happen: the batch gap rule on a stream of position reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "mmsi string, gap_start double, gap_end double, duration_min double"


def stream_gaps(reports: DataFrame, threshold_min: float, lateness: str = "1 hour") -> DataFrame:
    """reports (mmsi, timestamp) as a stream -> a row for each silence over the threshold.

    State is one time a vessel. Reports later than the watermark, or before the vessel's last one, are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t.timestamp() for frame in frames for t in frame["timestamp"])
        found = []
        for t in times:
            if last is not None and t <= last:
                continue
            if last is not None and (t - last) / 60 > threshold_min:
                found.append((key[0], last, t, (t - last) / 60))
            last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(found, columns=["mmsi", "gap_start", "gap_end", "duration_min"])

    timed = reports.withWatermark("timestamp", lateness)
    return timed.groupBy("mmsi").applyInPandasWithState(step, OUT, "last double", "append", GroupStateTimeout.NoTimeout)


def sessions(reports: DataFrame, minutes: int, lateness: str = "1 hour") -> DataFrame:
    """Voyages between silences, by session windows; a pause of exactly the limit stays inside."""
    timed = reports.withWatermark("timestamp", lateness)
    found = timed.groupBy("mmsi", F.session_window("timestamp", f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("mmsi", F.col("session_window.start").alias("start"), "n")
