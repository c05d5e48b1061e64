"""Streaming forms of two state machines. The tables are complete and ordered, so the queries
are batch; these serve sources that grow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event time and kind; state older than the watermark goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap_seconds: int, late: str = "2 hours") -> DataFrame:
    """``user_id, start, stop, n``: sessions of a user, measured from the previous row's end (seconds).

    ``events``: user_id, ts, seconds. A session is returned when a row of the user begins more
    than the gap behind it, or when the watermark has passed its end and the gap; then its state
    is removed, so state is bounded by the users seen within the gap and the allowed lateness.
    Rows behind the watermark are left out.
    """
    names = ["user_id", "start", "stop", "n"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame([(key[0], *state.get)], columns=names)
            state.remove()
            return
        start, stop, n = state.get if state.exists else (None, None, 0)
        closed = []
        for row in pd.concat([*batches]).sort_values("start").itertuples():
            if n and row.start - stop > gap_seconds:
                closed.append((key[0], start, stop, n))
                n = 0
            start = row.start if not n else min(start, row.start)
            stop = row.stop if not n else max(stop, row.stop)
            n += 1
        state.update((float(start), float(stop), int(n)))
        state.setTimeoutTimestamp(max(int((stop + gap_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=names)

    at = F.col("ts").cast("double")
    rows = events.withWatermark("ts", late).select("user_id", "ts", at.alias("start"), (at + F.col("seconds")).alias("stop"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, start double, stop double, n long", "start double, stop double, n long", "append", GroupStateTimeout.EventTimeTimeout)
