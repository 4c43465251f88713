"""Live alerts: deduplication, windows and anchored clusters on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "60 minutes"
_CLUSTERS = "key string, window_start timestamp, last timestamp, n long"
_STATE = "start timestamp, last timestamp, n long"


def dedup(alerts: DataFrame, keys: list[str], time: str = "ts", late: str = LATE) -> DataFrame:
    """Alerts without those that repeat all keys within the watermark."""
    return alerts.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def window_counts(alerts: DataFrame, key: str, time: str = "ts", size: str = "15 minutes", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts by key and tumbling or sliding window."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return alerts.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(alerts: DataFrame, key: str, time: str = "ts", gap: str = "60 minutes", late: str = LATE) -> DataFrame:
    """Counts by key and session."""
    s = alerts.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def anchored_clusters(alerts: DataFrame, key: str, time: str = "ts", minutes: int = 60, late: str = LATE) -> DataFrame:
    """key, window_start, last, n of each window that takes all within ``minutes`` of its first alert.

    A window is given out when a later alert opens another, or when the
    watermark passes its end. State is one open window for each key; an alert
    that is older than its open window, within the watermark, is a window of
    its own.
    """
    span = pd.Timedelta(minutes=minutes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        if state.hasTimedOut:
            start, last, n = state.get
            done.append((k[0], start, last, n))
            state.remove()
        else:
            times = sorted(t for b in batches for t in b[time])
            start, last, n = state.get if state.exists else (None, None, 0)
            for t in times:
                if start is not None and t < pd.Timestamp(start):
                    done.append((k[0], t, t, 1))
                elif start is None or t - pd.Timestamp(start) > span:
                    if start is not None:
                        done.append((k[0], start, last, n))
                    start, last, n = t, t, 1
                else:
                    last, n = t, n + 1
            if start is not None:
                state.update((pd.Timestamp(start).to_pydatetime(), pd.Timestamp(last).to_pydatetime(), n))
                end = int((pd.Timestamp(start) + span).timestamp() * 1000)
                if end > state.getCurrentWatermarkMs():
                    state.setTimeoutTimestamp(end)
                else:
                    done.append((k[0], start, last, n))
                    state.remove()
        yield pd.DataFrame(done, columns=["key", "window_start", "last", "n"])

    keyed = alerts.withWatermark(time, late).select(F.col(key).cast("string").alias("key"), time)
    return keyed.groupBy("key").applyInPandasWithState(step, _CLUSTERS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
