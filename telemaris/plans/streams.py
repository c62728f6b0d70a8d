"""Queries that drain a stream over the given files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from telemaris.plans.registry import query
from telemaris.plans.security import PAIRS
from telemaris.streaming import activity


#: Later than all events, by more than any window and delay below.
END = dt.datetime(2100, 1, 1)


@query("stream_tumbling_counts", "SELECT epoch_ms(time_bucket(INTERVAL 10 MINUTE, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, sf_dir):
    """Ten-minute counts as a stream in append mode: each window once, when the watermark has passed it."""
    events = activity.closed(activity.source(spark, sf_dir, "events"), "ts", END, event_type="")
    return activity.drained(spark, activity.tumbling(events, "ts", 10, "1 hour", "event_type"), "stream")


@query(
    "stream_scans",
    "SELECT epoch_ms(time_bucket(INTERVAL 60 MINUTE, ts)) AS start, user_id % 3 AS source, count(DISTINCT event_id % 40) AS ports FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_id % 40) > 3",
)
def stream_scans(spark, sf_dir):
    """Sources with more than three different ports in an hour, counted exactly in append mode."""
    events = activity.closed(activity.source(spark, sf_dir, "events"), "ts", END, event_id=-1, user_id=-1)
    rows = events.select("ts", (F.col("user_id") % 3).alias("source"), (F.col("event_id") % 40).alias("port"))
    return activity.drained(spark, activity.scans(rows, "ts", "source", "port", 3, 60, "10 minutes"), "scans")


@query("stream_detections", PAIRS.replace("AND e.event_id <> n.entry_id", "AND e.event_type <> 'error'") + "SELECT n.entry_id, n.user_id, d.event_id, d.gap FROM n LEFT JOIN d ON n.entry_id = d.entry_id AND d.r = 1")
def stream_detections(spark, sf_dir):
    """interval_match over other events than errors, as a stream: the nearest within three hours, else five, else null."""
    events = activity.source(spark, sf_dir, "events")
    entries = activity.closed(events.where("event_type = 'error'").select(F.col("event_id").alias("entry_id"), F.col("ts").alias("entry_ts"), "user_id"), "entry_ts", END, user_id=-1)
    others = activity.closed(events.where("event_type <> 'error'").select("event_id", F.col("ts").alias("event_ts"), "user_id"), "event_ts", END, user_id=-1)
    return activity.drained(spark, activity.detections(entries, others, "user_id", "1 hour", 10_800, 18_000), "detections")


@query(
    "stream_matches",
    """
    SELECT n.event_id AS entry_id, e.event_id FROM events n JOIN events e ON n.user_id = e.user_id AND n.event_type = 'error' AND e.event_type <> 'error'
    AND e.ts BETWEEN n.ts - INTERVAL 3 HOUR AND n.ts + INTERVAL 3 HOUR
    """,
)
def stream_matches(spark, sf_dir):
    """Errors and the other events of their user within three hours, joined as two streams."""
    events = activity.source(spark, sf_dir, "events")
    entries = events.where("event_type = 'error'").select(F.col("event_id").alias("entry_id"), F.col("ts").alias("entry_ts"), "user_id")
    others = events.where("event_type <> 'error'").select("event_id", F.col("ts").alias("event_ts"), "user_id")
    return activity.drained(spark, activity.matches(entries, others, "user_id", 10_800, "1 day"), "matches")
