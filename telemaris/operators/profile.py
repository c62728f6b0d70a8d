"""Profiles of tables: frequencies, summaries, missing values, histograms, activity over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from telemaris.operators.ordered import exact_quantiles, selected


def share(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, pct): how often each value is; the total is one row that goes to every task."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__total"))
    return counts.join(F.broadcast(total)).withColumn("pct", 100.0 * F.col("n") / F.col("__total")).drop("__total")


def describe(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max).

    Exact quartiles are selected between sketches' brackets; with approximate, one aggregation of sketches of 10,000 values.
    """
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000) if approximate else F.lit(None).cast("array<double>")
    stats = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
        quartiles(c).alias("q"), F.max(c).cast("double").alias("max"),
    )
    row = df.agg(F.array(*map(stats, columns)).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    if approximate:
        return row.select("column", "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")
    quarters = exact_quantiles(df, {c: c for c in columns}, [0.25, 0.5, 0.75]).select(F.col("name").alias("column"), F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    return row.join(quarters, "column", "left").select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing, total, pct, status): GOOD without missing values, ISSUE below 5 %, else CRITICAL."""
    columns = columns or df.columns
    row = df.agg(F.count("*").alias("total"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = row.unpivot("total", columns, "column", "missing")
    pct = F.coalesce(F.try_divide(F.lit(100.0) * F.col("missing"), F.col("total")), F.lit(0.0))
    return long.withColumn("pct", pct).withColumn("status", F.when(F.col("missing") == 0, "GOOD").when(F.col("pct") < 5, "ISSUE").otherwise("CRITICAL"))


def columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, type, non_null, null_pct, n_distinct, sample): the least value is the sample, so reruns agree.

    Different values are counted from (column, value) rows, each once per task before the shuffle; with approximate, by sketch.
    """
    distinct = F.approx_count_distinct if approximate else lambda c: F.lit(None).cast("long")
    stats = lambda f: F.struct(
        F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(f.name).alias("non_null"), F.count("*").alias("total"),
        distinct(F.col(f.name)).alias("n_distinct"), F.min(F.col(f.name).cast("string")).alias("sample"),
    )
    out = df.agg(F.array(*map(stats, df.schema)).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    if not approximate:
        values = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns))).alias("x")).select("x.*")
        counts = values.where("v is not null").groupBy("column", "v").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("n_distinct"))
        out = out.drop("n_distinct").join(counts, "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    return out.select("column", "type", "non_null", (100.0 * (F.col("total") - F.col("non_null")) / F.col("total")).alias("null_pct"), "n_distinct", "sample")


def fill_rate(df: DataFrame) -> DataFrame:
    filled = sum((F.count(c) for c in df.columns[1:]), F.count(df.columns[0]))
    return df.agg((filled / (F.count("*") * len(df.columns))).alias("fill_rate"))


def readiness(df: DataFrame, columns_: list[str]) -> DataFrame:
    """(score, verdict): 1 for a column filled above 90 %, 0.5 above 50 %; bands at 90, 75 and 60 %."""
    points = missing(df, columns_).select(F.when(F.col("pct") < 10, 1.0).when(F.col("pct") < 50, 0.5).otherwise(0.0).alias("p"))
    score = points.agg((100 * F.avg("p")).alias("score"))
    return score.withColumn("verdict", F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 60, "fair").otherwise("poor"))


def hourly(df: DataFrame, ts: str, value: Column) -> DataFrame:
    """(hour, n, total) for all 24 hours."""
    found = df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(found, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def peak(counts: DataFrame, at: str, n: str) -> DataFrame:
    """One row over bins: the fullest (the first on ties), its count, and the mean per bin."""
    return counts.agg(F.min_by(at, F.struct((-F.col(n)).alias("n"), at)).alias("peak"), F.max(n).alias("most"), F.avg(n).alias("mean"))


def daily(df: DataFrame, ts: str, value: Column) -> DataFrame:
    """(day, n, total)."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def tumbling(df: DataFrame, ts: str, minutes: int, *keys: str) -> DataFrame:
    """(start, keys, n): counts by aligned windows; start in epoch milliseconds."""
    return df.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.unix_millis(F.col("w.start").cast("timestamp")).alias("start"), *keys, "n")


def gap_filled(counts: DataFrame, minutes: int) -> DataFrame:
    """tumbling() counts with every window between the first and the last, 0 where nothing was."""
    step = minutes * 60_000
    ends = counts.agg(F.min("start").alias("a"), F.max("start").alias("b"))
    bins = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("start"))
    return bins.join(counts, "start", "left").select("start", F.coalesce("n", F.lit(0)).alias("n"))


def rate(df: DataFrame, ts: str) -> DataFrame:
    """(n, seconds, per_second, per_minute, per_hour) over the span of the table."""
    span = (F.unix_millis(F.max(ts)) - F.unix_millis(F.min(ts))) / 1000.0
    row = df.agg(F.count("*").alias("n"), span.alias("seconds"))
    return row.select("n", "seconds", *(F.try_divide(F.col("n") * k, F.col("seconds")).alias(f"per_{u}") for u, k in (("second", 1), ("minute", 60), ("hour", 3600))))


def crosstab(df: DataFrame, row: str | Column, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def histogram(df: DataFrame, value: str, bins: int, low: Column, high: Column, *keys: str) -> DataFrame:
    """(keys, bin, n): equal bins from 0; the right edge belongs to the last bin."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def mode(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """The most frequent value, the smallest on ties."""
    return df.groupBy(*keys).agg(F.mode(column, deterministic=True).alias(column))


def above_quantile(df: DataFrame, column: str, q: float, approximate: bool = False) -> DataFrame:
    """Rows above a quantile of the whole table, with it as `limit`: a constant, so the filter reaches the scan."""
    limit = df.agg(F.percentile_approx(column, q, 100_000)).first()[0] if approximate else selected(df, {"x": column}, [q])["x"][0]
    return df.where(F.col(column) > F.lit(limit).cast("double")).withColumn("limit", F.lit(limit).cast("double"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def feature_variance(df: DataFrame, features: str, k: int) -> DataFrame:
    """(feature, variance): the k positions of array features that vary most (population variance)."""
    long = df.select(F.posexplode(features).alias("feature", "x"))
    return long.groupBy("feature").agg(F.var_pop("x").alias("variance")).orderBy(F.desc("variance"), "feature").limit(k)


def lengths(df: DataFrame, array: str) -> DataFrame:
    """One row about an array column's lengths; null counts as empty."""
    n = F.coalesce(F.size(F.when(F.col(array).isNotNull(), F.col(array))), F.lit(0))
    return df.agg(F.avg(n).alias("mean"), F.max(n).cast("long").alias("most"), F.count_if(n == 0).alias("empty"), F.count_if(n > 5).alias("many"))


def text_columns(df: DataFrame, columns_: list[str], low: int = 20) -> DataFrame:
    """(column, empty_pct, mean_length, n_distinct, low_cardinality) of text columns; values are told apart by 64-bit hashes, counted exactly."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias("h"), F.length(c).alias("size")) for c in columns_))
    values = df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("column", "h", "size").agg(F.count("*").alias("n"))
    empty = F.sum(F.when(F.coalesce("size", F.lit(0)) == 0, F.col("n")).otherwise(0))
    filled = F.sum(F.when(F.col("h").isNotNull(), F.col("n")))
    out = values.groupBy("column").agg((100.0 * empty / F.sum("n")).alias("empty_pct"), (F.sum(F.col("size") * F.col("n")) / filled).alias("mean_length"), F.count("h").alias("n_distinct"))
    return out.withColumn("low_cardinality", F.col("n_distinct") <= low)


def summary(df: DataFrame, ts: str, key: str) -> DataFrame:
    """One row: rows, distinct keys, first and last time (epoch ms), and rows per hour of the span."""
    span = (F.unix_millis(F.max(ts)) - F.unix_millis(F.min(ts))) / 3_600_000
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.unix_millis(F.min(ts)).alias("first"), F.unix_millis(F.max(ts)).alias("last"), F.try_divide(F.count("*"), span).alias("per_hour"))


def report(df: DataFrame, ts: str, kinds: list[str], checked: list[str], created: Column, command: str) -> DataFrame:
    """(section, name, value): a table's summary as rows, which a report of one JSON object is made of.

    dataset: records, columns and readiness of the `checked` columns; one section per column in `kinds`: how often each value is;
    missing: nulls by column; time: first and last (epoch ms), seconds between them, rows with a time and their share in %;
    process: rows of `created`, those with a command, and their share in %. Null values have the name 'null'.
    """
    row = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("double").alias("value"))
    counts = df.agg(F.count("*").alias("n"), F.count(ts).alias("timed"), F.unix_millis(F.min(ts)).alias("first"), F.unix_millis(F.max(ts)).alias("last"), F.count_if(created).alias("made"), F.count(F.when(created, F.col(command))).alias("commands"))
    facts = counts.join(readiness(df, checked)).select(
        F.explode(
            F.array(
                row("dataset", "records", F.col("n")), row("dataset", "columns", F.lit(len(df.columns))), row("dataset", "readiness", F.col("score")),
                row("time", "first", F.col("first")), row("time", "last", F.col("last")), row("time", "seconds", (F.col("last") - F.col("first")) / 1000), row("time", "rows", F.col("timed")), row("time", "pct", F.try_divide(100 * F.col("timed"), F.col("n"))),
                row("process", "created", F.col("made")), row("process", "commands", F.col("commands")), row("process", "pct", F.try_divide(100 * F.col("commands"), F.col("made"))),
            )
        ).alias("x")
    ).select("x.*")
    gaps = missing(df).select(F.lit("missing").alias("section"), F.col("column").alias("name"), F.col("missing").cast("double").alias("value"))
    out = facts.unionByName(gaps)
    for kind in kinds:
        out = out.unionByName(df.groupBy(F.coalesce(F.col(kind).cast("string"), F.lit("null")).alias("name")).agg(F.count("*").cast("double").alias("value")).withColumn("section", F.lit(kind)))
    return out


def distinct_sketches(long: DataFrame, by: list[str], column: str, value: str, bits: int = 14) -> DataFrame:
    """(by, column, n, filled, sketch): rows, values and a mergeable sketch of the different values for each part and column.

    Kept per day or file, the sketches of any range are merged by distinct_over() without another look at its rows. The standard
    error of an estimate is about 1.04 / sqrt(2 ** bits), 0.8 % for 14.
    """
    sketch = F.hll_sketch_agg(F.col(value).cast("string"), F.lit(bits))
    return long.groupBy(*by, column).agg(F.count("*").alias("n"), F.count(value).alias("filled"), sketch.alias("sketch"))


def distinct_over(sketches: DataFrame, column: str) -> DataFrame:
    """(column, n, filled, n_distinct): of all parts given, with about the number of different values."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(column).agg(F.sum("n").alias("n"), F.sum("filled").alias("filled"), merged.alias("n_distinct"))


def long_columns(df: DataFrame, keep: list[str], columns_: list[str]) -> DataFrame:
    """(keep, column, value): a row for each of the columns, values as text."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns_))
    return df.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.*")
