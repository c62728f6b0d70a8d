"""Streams: windowed counts, scans and interval matches over unbounded input, with watermarks that bound the state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemaris.session import shared_dir


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over folder/name.parquet, a folder of files or a single one; zone-less times become instants."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    is_folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema)
    rows = reader.parquet(f"{folder}/{name}.parquet") if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"})


def tumbling(stream: DataFrame, ts: str, minutes: int, late: str, *keys: str) -> DataFrame:
    """(start, keys, n): counts by aligned windows; rows later than the watermark are left out."""
    window = F.window(ts, f"{minutes} minutes").alias("w")
    counts = stream.withWatermark(ts, late).groupBy(window, *keys).agg(F.count("*").alias("n"))
    return counts.select(F.unix_millis("w.start").alias("start"), *keys, "n")


def scans(stream: DataFrame, ts: str, source: str, port: str, most_ports: int, minutes: int, late: str) -> DataFrame:
    """(start, source, ports): sources with more than most_ports different ports in a window, exactly; append mode.

    Two stateful steps: a port is let through once per window and source, then what came through is counted. Both keep a
    window's state until the watermark passes its end, and emit it then.
    """
    window = F.window(ts, f"{minutes} minutes").alias("w")
    once = stream.withWatermark(ts, late).where(F.col(port).isNotNull()).select(window, source, port).dropDuplicates(["w", source, port])
    counts = once.groupBy("w", source).agg(F.count("*").alias("ports"))
    return counts.where(F.col("ports") > most_ports).select(F.unix_millis("w.start").alias("start"), source, "ports")


def approximate_scans(stream: DataFrame, ts: str, source: str, port: str, most_ports: int, minutes: int, late: str) -> DataFrame:
    """scans() with about the number of ports: a sketch per source and window is kept instead of all its ports."""
    window = F.window(ts, f"{minutes} minutes").alias("w")
    counts = stream.withWatermark(ts, late).groupBy(window, source).agg(F.approx_count_distinct(port, 0.02).alias("ports"))
    return counts.where(F.col("ports") > most_ports).select(F.unix_millis("w.start").alias("start"), source, "ports")


def matches(entries: DataFrame, events: DataFrame, host: str, seconds: int, late: str) -> DataFrame:
    """(entry_id, event_id): stream-stream join on the host within a time window; both sides' state ends with the watermark."""
    left = entries.withWatermark("entry_ts", late).alias("l")
    right = events.withWatermark("event_ts", late).alias("r")
    near = F.expr(f"r.event_ts BETWEEN l.entry_ts - INTERVAL {seconds} SECONDS AND l.entry_ts + INTERVAL {seconds} SECONDS")
    return left.join(right, (F.col(f"l.{host}") == F.col(f"r.{host}")) & near).select("entry_id", "event_id")


def detections(entries: DataFrame, events: DataFrame, host: str, late: str, seconds: int = 180, fallback: int = 300) -> DataFrame:
    """(entry_id, host, event_id, gap): each entry's nearest event within `seconds`, else within `fallback`, else null; append mode.

    A left outer join within `fallback` gives an entry its events, or none once the watermark says that there will be none; its
    candidates are then brought down to one per entry and entry time. Both steps' state ends with the watermark.
    """
    left = entries.withWatermark("entry_ts", late).alias("l")
    right = events.withWatermark("event_ts", late).select("event_id", "event_ts", F.col(host).alias("__host")).alias("r")
    near = F.expr(f"event_ts BETWEEN entry_ts - INTERVAL {fallback} SECONDS AND entry_ts + INTERVAL {fallback} SECONDS")
    both = left.join(right, (F.col(host) == F.col("__host")) & near, "left_outer")
    gap = F.abs(F.unix_millis("event_ts") - F.unix_millis("entry_ts"))
    hit = F.when(F.col("event_id").isNotNull(), F.struct((gap > seconds * 1000).alias("late"), gap.alias("gap"), F.col("event_id")))
    best = both.groupBy(F.window("entry_ts", "1 minute").alias("w"), "entry_id", host).agg(F.min(hit).alias("hit"))
    return best.select("entry_id", host, F.col("hit.event_id").alias("event_id"), F.col("hit.gap").alias("gap"))


def closed(stream: DataFrame, ts: str, at: dt.datetime, **values: object) -> DataFrame:
    """The stream and one row at a later time, which moves the watermark past all others: a drained stream then closes them all.

    Its other columns are null but for `values`. Keys must have one: rows with null keys may be filtered ahead of the watermark.
    The row's own window stays open, so it is in no result.
    """
    spark = stream.sparkSession
    folder = shared_dir(spark, "closing")
    given = values | {ts: at}
    spark.range(1).select(*(F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema)).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives from the input there is now, through a file sink with a checkpoint: exactly once after a restart.

    In append mode the windows that the watermark has not closed yet stay in the state.
    """
    folder = shared_dir(spark, name)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append")
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/rows")).option("checkpointLocation", f"{folder}/state").outputMode(mode)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
