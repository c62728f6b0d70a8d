"""Structure of documents and events: fingerprints, patterns, coverage, extraction plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from telemaris.operators.ordered import running


def field_types(df: DataFrame, json: str) -> DataFrame:
    """(field, type, n, pct): types of the top-level fields of JSON objects."""
    fields = df.select(F.explode(F.expr(f"cast(try_parse_json({json}) as map<string,variant>)")).alias("field", "v"))
    counts = fields.groupBy("field", F.schema_of_variant("v").alias("type")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("field")))


def field_profile(df: DataFrame, json: str, low: int = 20) -> DataFrame:
    """(field, n, empty_pct, mean_length, n_distinct, low_cardinality) of the top-level fields of JSON objects, values as text.

    Different values are counted exactly, by field and value first.
    """
    fields = df.select(F.explode(F.expr(f"cast(try_parse_json({json}) as map<string,variant>)")).alias("field", "v"))
    text = F.coalesce(F.when(F.schema_of_variant("v").isin("STRING", "BIGINT", "BOOLEAN"), F.col("v").cast("string")), F.to_json("v"), F.lit(""))
    values = fields.select("field", text.alias("x")).groupBy("field", "x").agg(F.count("*").alias("n"))
    out = values.groupBy("field").agg(
        F.sum("n").alias("n"), (F.lit(100.0) * F.sum(F.when(F.col("x") == "", F.col("n")).otherwise(0)) / F.sum("n")).alias("empty_pct"),
        (F.sum(F.length("x") * F.col("n")) / F.sum("n")).alias("mean_length"), F.count("*").alias("n_distinct"),
    )
    return out.withColumn("low_cardinality", F.col("n_distinct") <= low)


def paths(df: DataFrame, json: str, depth: int) -> DataFrame:
    """(path, n): paths of nested objects down to `depth`; of an array its first element."""
    level = df.select(F.lit("").alias("path"), F.expr(f"try_parse_json({json})").alias("v"))
    out = None
    for _ in range(depth):
        inner = F.expr("try_cast(coalesce(try_variant_get(v, '$[0]', 'variant'), v) as map<string,variant>)")
        level = level.select("path", F.explode(inner).alias("k", "v"))
        level = level.select(F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), "k").alias("path"), "v")
        out = level.select("path") if out is None else out.unionByName(level.select("path"))
    return out.groupBy("path").agg(F.count("*").alias("n"))


def json_fingerprint(json: str) -> Column:
    """md5 of a document's structure: sorted keys and types, no values."""
    return F.md5(F.schema_of_variant(F.try_parse_json(json)))


def event_fingerprint(event_id: str, fields: str) -> Column:
    """md5 of an event's id and of which of its fields are present or null, in order of name."""
    parts = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.when(e["value"].isNull(), ":null").otherwise(":present"))))
    return F.md5(F.concat_ws("|", F.col(event_id).cast("string"), F.array_join(parts, "|")))


def patterns(df: DataFrame, fingerprint: str | Column) -> DataFrame:
    """(pattern, n, pct, class, frequency, rank, coverage): classes by share at 50, 20, 5 and 1 %."""
    key = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    counts = df.groupBy(key.alias("pattern")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__total"))
    placed = running(counts, [F.desc("n"), "pattern"], {"rank": F.lit(1), "upto": "n"}).join(F.broadcast(total))
    share = lambda c: 100.0 * F.col(c) / F.col("__total")
    out = placed.select("pattern", "n", share("n").alias("pct"), F.col("rank").cast("int").alias("rank"), share("upto").alias("coverage"))
    kind = F.when(F.col("pct") >= 50, "PRIMARY").when(F.col("pct") >= 20, "SECONDARY").when(F.col("pct") >= 5, "VARIANT").when(F.col("pct") >= 1, "RARE_VARIANT").otherwise("OUTLIER")
    often = F.when(F.col("pct") >= 5, "common").when(F.col("pct") >= 1, "uncommon").otherwise("rare")
    return out.withColumn("class", kind).withColumn("frequency", often)


def verdict(found: DataFrame, top: int = 5) -> DataFrame:
    """(coverage, verdict): what the first `top` patterns cover; bands at 95, 90 and 80 %."""
    row = found.where(F.col("rank") <= top).agg(F.max("coverage").alias("coverage"))
    return row.withColumn("verdict", F.when(F.col("coverage") >= 95, "HIGHLY_CONSISTENT").when(F.col("coverage") >= 90, "CONSISTENT").when(F.col("coverage") >= 80, "MODERATE").otherwise("INCONSISTENT"))


def identity_verdict(consistent: DataFrame) -> DataFrame:
    """(ratio, diversity, verdict) over consistency(): the share of keys with one pattern, and patterns per row; bands at 80 and 60 %, 1 and 5 %."""
    row = consistent.agg(F.avg(F.col("consistent").cast("double")).alias("ratio"), (F.sum("patterns") / F.sum("n")).alias("diversity"))
    good = (F.col("ratio") >= 0.8) & (F.col("diversity") <= 0.01)
    fair = (F.col("ratio") >= 0.6) & (F.col("diversity") <= 0.05)
    return row.withColumn("verdict", F.when(good, "HIGHLY_CONSISTENT").when(fair, "MODERATELY_CONSISTENT").otherwise("INCONSISTENT"))


def consistency(df: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, n, patterns, consistent): a key with one pattern is consistent."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(fingerprint).alias("patterns")).withColumn("consistent", F.col("patterns") == 1)


def presence(df: DataFrame, row_key: str, field: str) -> DataFrame:
    """(field, n, pct, kind) over exploded (row, field) pairs: always from 95 %, rare below 5 %, else conditional."""
    total = df.agg(F.count_distinct(row_key).alias("total"))
    counts = df.groupBy(field).agg(F.count_distinct(row_key).alias("n")).join(F.broadcast(total))
    pct = 100.0 * F.col("n") / F.col("total")
    return counts.withColumn("pct", pct).withColumn("kind", F.when(F.col("pct") >= 95, "always").when(F.col("pct") < 5, "rare").otherwise("conditional")).drop("total")


def combinations(df: DataFrame, row_key: str, field: str) -> DataFrame:
    """(fields, n): how many rows have exactly these fields. A row's fields are few."""
    return df.groupBy(row_key).agg(F.array_sort(F.collect_set(field)).alias("fields")).groupBy("fields").agg(F.count("*").alias("n"))


def extraction_plan(found: DataFrame, fields: str, wanted: list[str]) -> DataFrame:
    """Of each pattern (with its array of fields): wanted fields it has, those it lacks, and a priority by share."""
    want = F.array(*map(F.lit, wanted))
    priority = F.when(F.col("pct") >= 50, "HIGH").when(F.col("pct") >= 20, "MEDIUM").when(F.col("pct") >= 5, "LOW").otherwise("OPTIONAL")
    return found.withColumn("core", F.array_sort(F.array_intersect(fields, want))).withColumn("lacking", F.array_sort(F.array_except(want, F.col(fields)))).withColumn("priority", priority)
