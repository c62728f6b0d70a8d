"""Streams over several files give what a batch over all of them gives; late rows are left out in append mode."""

import datetime as dt

from pyspark.sql import functions as F

from telemaris.streaming import activity

SCHEMA = "id long, ts timestamp, k string, port long"
T0 = dt.datetime(2025, 1, 1)


def write(spark, path, rows):
    data = [(i, T0 + dt.timedelta(minutes=m), k, p) for i, m, k, p in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_counts_of_many_files(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    for part in range(3):
        write(spark, path, [(10 * part + i, 7 * i + part, "ab"[i % 2], i) for i in range(10)])
    stream = activity.source(spark, str(tmp_path), "events")
    found = activity.drained(spark, activity.tumbling(stream, "ts", 10, "1 day", "k"), "t", "complete")
    batch = spark.read.parquet(path).groupBy(F.window("ts", "10 minutes").alias("w"), "k").count().select(F.unix_millis("w.start"), "k", "count")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))


def test_append_mode_closes_windows(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    write(spark, path, [(i, i, "a", i) for i in range(60)])
    stream = activity.source(spark, str(tmp_path), "events")
    found = activity.drained(spark, activity.tumbling(stream, "ts", 10, "15 minutes"), "t").collect()
    assert {r.n for r in found} == {10} and 0 < len(found) <= 5  # the last windows stay open


def test_scans_count_each_port_once_and_leave_late_rows_out(spark, tmp_path):
    """Two files, one after the other: what comes for a window that the first one closed is not counted."""
    path, rows = str(tmp_path / "events.parquet"), activity.source
    write(spark, path, [(i, i % 8, "scanner", i % 30) for i in range(300)] + [(i, 1, "quiet", 5) for i in range(300, 400)] + [(400, 50, "quiet", 1)])
    stream = lambda: activity.scans(activity.closed(rows(spark, str(tmp_path), "events"), "ts", T0 + dt.timedelta(days=9), k="", port=0), "ts", "k", "port", 3, 10, "5 minutes")
    found = activity.drained(spark, stream(), "s").collect()
    assert [(r.k, r.ports) for r in found] == [("scanner", 30)]
    folder = str(tmp_path / "out")

    def step():
        counts = activity.scans(activity.source(spark, str(tmp_path), "events"), "ts", "k", "port", 3, 10, "5 minutes")
        query = counts.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append")
        query.trigger(availableNow=True).start().awaitTermination()

    step()
    write(spark, path, [(500 + i, 2, "scanner", 100 + i) for i in range(50)] + [(600 + i, 52, "other", i) for i in range(5)] + [(700, 90, "quiet", 1)])
    step()
    assert sorted((r.k, r.ports) for r in spark.read.parquet(f"{folder}/rows").collect()) == [("other", 5), ("scanner", 30)]


def test_detections_keep_entries_that_find_nothing(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    entries = [(1, at(1000), "a"), (2, at(5000), "a"), (3, at(1000), "b"), (4, at(9000), None)]
    events = [(10, at(1150), "a"), (11, at(800), "a"), (12, at(5250), "a"), (13, at(4790), "a"), (14, at(1301), "b"), (15, at(850), "a")]
    spark.createDataFrame(entries, "entry_id long, entry_ts timestamp, host string").write.parquet(str(tmp_path / "entries.parquet"))
    spark.createDataFrame(events, "event_id long, event_ts timestamp, host string").write.parquet(str(tmp_path / "events.parquet"))
    left, right = (activity.closed(activity.source(spark, str(tmp_path), n), f"{k}_ts", T0 + dt.timedelta(days=9), host="") for n, k in (("entries", "entry"), ("events", "event")))
    found = activity.drained(spark, activity.detections(left, right, "host", "1 minute"), "d").collect()
    assert sorted((r.entry_id, r.event_id, r.gap) for r in found) == [(1, 10, 150_000), (2, 13, 210_000), (3, None, None), (4, None, None)]


def test_approximate_scans_in_a_stream(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    write(spark, path, [(i, 1, "scanner", i) for i in range(300)] + [(i, 1, "quiet", 5) for i in range(300, 400)])
    found = activity.drained(spark, activity.approximate_scans(activity.source(spark, str(tmp_path), "events"), "ts", "k", "port", 100, 10, "1 hour"), "s", "complete").collect()
    assert [r.k for r in found] == ["scanner"]
