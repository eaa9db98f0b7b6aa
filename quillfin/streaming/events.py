"""Windows of event time: one plan for a table and for a stream.

Over a table the watermark is ignored and every window comes out. Over a stream a window comes out once, when
the watermark has passed its end, and its state is dropped; rows that come later still are not counted in
any window, but their number is in the query's progress (``late``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# How far rows may come behind the newest one.
LATENESS = "10 minutes"


def _aggregated(events: DataFrame, window: Column, keys: list[str], value: str, time: str, lateness: str) -> DataFrame:
    # Sums of decimals do not depend on the order in which tasks add them.
    amount = F.col(value).cast("decimal(28,6)")
    return (
        events.withWatermark(time, lateness)
        .groupBy(window.alias("window"), *keys)
        .agg(F.count("*").alias("n"), F.sum(amount).cast("double").alias("total"), F.max(value).alias("highest"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total", "highest")
    )


def tumbling(events: DataFrame, every: str, keys: list[str], value: str = "value", time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Count, sum and maximum of ``value`` for each window of ``every`` and key. Rows without a time are in none;
    a null key is a key."""
    return _aggregated(events, F.window(time, every), keys, value, time, lateness)


def sliding(events: DataFrame, length: str, every: str, keys: list[str], value: str = "value", time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """The same for windows of ``length`` that begin every ``every``; a row is in each that covers it."""
    return _aggregated(events, F.window(time, length, every), keys, value, time, lateness)


def sessions(events: DataFrame, gap: str, keys: list[str], value: str = "value", time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """The same for sessions: rows of a key that follow each other by less than ``gap``. A session ends
    ``gap`` after its last row."""
    return _aggregated(events, F.session_window(time, gap), keys, value, time, lateness)


def late(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the batches whose progress is kept. Late rows of one window, key
    and task are combined before they are dropped, and then count once."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
