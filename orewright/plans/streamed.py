"""Streaming queries over the events table, run over what there is."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orewright.streaming import streams as S


def _run(stream, mode):
    return S.run(stream, "ore_" + uuid.uuid4().hex[:12], mode)


def _ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


QUERIES = {
    "stream_tumbling": lambda s, d: _ntz(_run(S.windowed(S.events_stream(s, d), "ts", "1 hour", "1 hour", by=("event_type",)), "complete"), "start").withColumn("total", F.round("total", 3)),
    "stream_sliding": lambda s, d: _ntz(_run(S.windowed(S.events_stream(s, d), "ts", "1 hour", "2 hours", "1 hour"), "complete"), "start").select("start", "n"),
    "stream_sessions": lambda s, d: _ntz(_run(S.session_counts(S.events_stream(s, d), "ts", "1 hour", "30 minutes", "user_id"), "complete"), "start", "end"),
    "stream_decay": lambda s, d: _run(S.decaying(S.events_stream(s, d).select("user_id", "event_id", "value"), "user_id", "event_id", "value", 0.7310585), "append").select("user_id", "event_id", F.round("resonance", 3).alias("resonance")),
    "stream_unseen": lambda s, d: _run(S.unseen(S.events_stream(s, d).select("ts", "user_id", "event_type"), "ts", "365 days", "user_id", "event_type"), "append").select("user_id", "event_type"),
}

SQL = {
    "stream_tumbling": "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "stream_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 hour, ts), time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour]) AS start FROM events) GROUP BY start",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_decay": """WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT a.user_id, a.event_id, round(sum(b.value * pow(0.7310585, a.i - b.i)), 3) AS resonance FROM n a JOIN n b ON a.user_id = b.user_id AND b.i <= a.i AND b.i > a.i - 80 GROUP BY ALL""",
    "stream_unseen": "SELECT DISTINCT user_id, event_type FROM events",
}
