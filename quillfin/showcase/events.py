"""Event-time windows over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillfin.showcase import Showcase, table
from quillfin.streaming import events

shown = Showcase()
add = shown.add

_AGG = "count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS total, max(value) AS highest"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events")
    return found.withColumn("ts", found["ts"].cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as in the table."""
    return df.withColumns({c: df[c].cast("timestamp_ntz") for c in ("window_start", "window_end")})


@add(f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, {_AGG}
FROM events GROUP BY ALL""")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(events.tumbling(_events(spark, sf_dir), "1 hour", ["event_type"]))


@add(f"""WITH placed AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS window_start, event_type, value FROM events, range(4) r(k))
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, {_AGG} FROM placed GROUP BY ALL""")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(events.sliding(_events(spark, sf_dir), "1 hour", "15 minutes", ["event_type"]))


@add(f"""WITH cut AS (SELECT user_id, ts, value, lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR AS begins
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, value, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM cut)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, {_AGG} FROM numbered GROUP BY user_id, session""")
def event_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(events.sessions(_events(spark, sf_dir), "6 hours", ["user_id"]))
