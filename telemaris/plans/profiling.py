"""Queries over activity, profiles and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemaris.functions import classify, clean
from telemaris.operators import ordered, profile, structure
from telemaris.plans.registry import query
from telemaris.session import shared_dir, table


@query(
    "flagship_activity",
    """
    WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, event_type, user_id, value FROM events),
         l AS (SELECT quantile_cont(value, 0.99) AS p99 FROM events)
    SELECT epoch_ms(w) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users,
           count(*) FILTER (WHERE value > p99) AS outliers
    FROM b, l GROUP BY w, event_type
    """,
)
def flagship_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute counts per event type, with distinct users and events above the 99th percentile."""
    events = table(spark, sf_dir, "events")
    limit = ordered.exact_quantile(events, "value", 0.99).withColumnRenamed("limit", "p99")
    rows = events.join(F.broadcast(limit))
    return (
        rows.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > F.col("p99")).alias("outliers"))
        .select(F.unix_millis("w.start").alias("start"), "event_type", "n", "users", "outliers")
    )


@query("event_type_share", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY event_type")
def event_type_share(spark, sf_dir):
    return profile.share(table(spark, sf_dir, "events"), "event_type").withColumn("pct", F.round("pct", 6))


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "numeric_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, "
        f"round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, max({c}) AS max FROM lineitem"
        for c in NUMERIC
    ),
)
def numeric_summary(spark, sf_dir):
    out = profile.describe(table(spark, sf_dir, "lineitem"), list(NUMERIC))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


#: Customers with their orders of 1995, which many don't have, so that columns have gaps.
GAPS = "(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, o_orderkey, o_totalprice, CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE c_name END AS name FROM customer LEFT JOIN (SELECT * FROM orders WHERE year(o_orderdate) = 1995 AND o_orderkey % 9 = 0) ON c_custkey = o_custkey)"
GAP_COLUMNS = ("c_custkey", "segment", "o_orderkey", "o_totalprice", "name")


def _gaps(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where((F.year("o_orderdate") == 1995) & (F.col("o_orderkey") % 9 == 0)).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    return rows.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "o_orderkey", "o_totalprice", F.when(F.col("c_custkey") % 40 != 0, F.col("c_name")).alias("name"))


MISSING = "SELECT *, 100.0 * missing / total AS pct, CASE WHEN missing = 0 THEN 'GOOD' WHEN 100.0 * missing / total < 5 THEN 'ISSUE' ELSE 'CRITICAL' END AS status FROM ("
MISSING += " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS total FROM g" for c in GAP_COLUMNS) + ")"


@query("missing_profile", f"WITH g AS {GAPS} {MISSING}")
def missing_profile(spark, sf_dir):
    return profile.missing(_gaps(spark, sf_dir))


EVENT_TYPES = {"event_id": "bigint", "ts": "bigint", "user_id": "bigint", "event_type": "string", "value": "bigint", "props": "string"}
EVENT_SQL = "(SELECT event_id, epoch_us(ts) // 1000 AS ts, user_id, nullif(event_type, 'view') AS event_type, round(value * 100)::BIGINT AS value, props FROM events)"


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, round(100.0 * (count(*) - count({c})) / count(*), 6)::DOUBLE AS null_pct, count(DISTINCT {c}) AS n_distinct, "
        f"min(CAST({c} AS VARCHAR)) AS sample FROM {EVENT_SQL}"
        for c, t in EVENT_TYPES.items()
    ),
)
def column_profile(spark, sf_dir):
    """All columns of events, times as milliseconds and values as cents, which both engines write alike."""
    events = table(spark, sf_dir, "events").select("event_id", F.unix_millis("ts").alias("ts"), "user_id", F.nullif("event_type", F.lit("view")).alias("event_type"), F.round(F.col("value") * 100).cast("long").alias("value"), "props")
    return profile.columns(events).withColumn("null_pct", F.round("null_pct", 6))


@query("fill_rate", f"SELECT (" + " + ".join(f"count({c})" for c in GAP_COLUMNS) + f")::DOUBLE / (count(*) * 5) AS fill_rate FROM {GAPS}")
def fill_rate(spark, sf_dir):
    return profile.fill_rate(_gaps(spark, sf_dir))


@query(
    "readiness",
    f"WITH g AS {GAPS}, m AS ({MISSING}), s AS (SELECT 100 * avg(CASE WHEN pct < 10 THEN 1.0 WHEN pct < 50 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM m) "
    "SELECT score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS verdict FROM s",
)
def readiness(spark, sf_dir):
    return profile.readiness(_gaps(spark, sf_dir), list(GAP_COLUMNS))


@query(
    "hourly_volume",
    "SELECT h.hour::INTEGER AS hour, count(e.event_id) AS n, round(coalesce(sum(value), 0), 4) AS total FROM range(24) h(hour) LEFT JOIN events e ON hour(e.ts) = h.hour GROUP BY h.hour",
)
def hourly_volume(spark, sf_dir):
    return profile.hourly(table(spark, sf_dir, "events"), "ts", F.col("value")).withColumn("total", F.round("total", 4))


@query(
    "daily_volume",
    "SELECT epoch_ms(ts::DATE::TIMESTAMP) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
)
def daily_volume(spark, sf_dir):
    out = profile.daily(table(spark, sf_dir, "events"), "ts", F.col("value"))
    return out.select(F.unix_millis(F.col("day").cast("timestamp")).alias("day"), "n", F.round("total", 4).alias("total"))


@query("peak_hour", "WITH h AS (SELECT hour(ts)::INTEGER AS hour, count(*) AS n FROM events GROUP BY 1) SELECT arg_min(hour, (-n, hour)) AS peak, max(n) AS most, round(sum(n) / 24.0, 6)::DOUBLE AS mean FROM h")
def peak_hour(spark, sf_dir):
    return profile.peak(profile.hourly(table(spark, sf_dir, "events"), "ts", F.col("value")), "hour", "n").withColumn("mean", F.round("mean", 6))


@query(
    "peak_bin",
    """
    WITH c AS (SELECT epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts)) AS start, count(*) AS n FROM events GROUP BY 1)
    SELECT arg_min(start, (-n, start)) AS peak, max(n) AS most, round(sum(n) / ((max(start) - min(start)) / 300000.0 + 1), 6)::DOUBLE AS mean FROM c
    """,
)
def peak_bin(spark, sf_dir):
    """The fullest five minutes, and the mean over all, empty ones too."""
    counts = profile.gap_filled(profile.tumbling(table(spark, sf_dir, "events"), "ts", 5), 5)
    return profile.peak(counts, "start", "n").withColumn("mean", F.round("mean", 6))


@query("weekday_volume", "SELECT isodow(ts) AS place, dayname(ts) AS weekday, count(*) AS n, count(DISTINCT ts::DATE) AS days, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def weekday_volume(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns(clean.calendar("ts"))
    return (
        events.groupBy(((F.dayofweek("ts") + 5) % 7 + 1).cast("long").alias("place"), "weekday")
        .agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"), F.round(F.sum("value"), 4).alias("total"))
    )


@query("tumbling_counts", "SELECT epoch_ms(time_bucket(INTERVAL 10 MINUTE, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return profile.tumbling(table(spark, sf_dir, "events"), "ts", 10, "event_type")


@query(
    "gap_filled_rate",
    """
    WITH c AS (SELECT epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts)) AS start, count(*) AS n FROM events GROUP BY 1),
         e AS (SELECT min(start) AS a, max(start) AS b FROM c)
    SELECT g.start, coalesce(n, 0) AS n FROM (SELECT unnest(range(a, b + 1, 300000)) AS start FROM e) g LEFT JOIN c USING (start)
    """,
)
def gap_filled_rate(spark, sf_dir):
    return profile.gap_filled(profile.tumbling(table(spark, sf_dir, "events"), "ts", 5), 5)


@query(
    "event_rate",
    """
    WITH r AS (SELECT count(*) AS n, (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) / 1000.0 AS seconds FROM events)
    SELECT n, seconds::DOUBLE AS seconds, round(n / seconds, 6) AS per_second, round(n * 60 / seconds, 6) AS per_minute, round(n * 3600 / seconds, 6) AS per_hour FROM r
    """,
)
def event_rate(spark, sf_dir):
    out = profile.rate(table(spark, sf_dir, "events"), "ts")
    return out.select("n", F.col("seconds").cast("double").alias("seconds"), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("per_second", "per_minute", "per_hour")))


@query("cumulative_events", "SELECT event_id, epoch_us(ts) // 1000 AS at, count(*) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS position FROM events")
def cumulative_events(spark, sf_dir):
    out = ordered.positions(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"])
    return out.select("event_id", F.unix_millis("ts").alias("at"), "position")


TYPES = ("click", "error", "purchase", "signup", "view")


@query("type_hour_crosstab", "SELECT hour(ts)::INTEGER AS hour, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY 1")
def type_hour_crosstab(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return profile.crosstab(events, F.hour("ts").alias("hour"), "event_type", list(TYPES))


@query(
    "value_histogram",
    """
    WITH r AS (SELECT min(value) AS a, max(value) AS b FROM events)
    SELECT event_type, least(floor((value - a) / ((b - a) / 20)), 19)::INTEGER AS bin, count(*) AS n FROM events, r GROUP BY 1, 2
    """,
)
def value_histogram(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return profile.histogram(events.join(F.broadcast(ends)), "value", 20, F.col("a"), F.col("b"), "event_type")


@query(
    "modal_type",
    """
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1
    """,
)
def modal_type(spark, sf_dir):
    return profile.mode(table(spark, sf_dir, "events"), "event_type", "user_id")


@query("volume_outliers", "SELECT l_orderkey, l_linenumber, l_extendedprice, round(x.q, 4) AS q FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.99) AS q FROM lineitem) x WHERE l_extendedprice > x.q")
def volume_outliers(spark, sf_dir):
    out = profile.above_quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.99)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round("limit", 4).alias("q"))


@query(
    "text_flags",
    r"""
    SELECT doc_id, regexp_matches(text, '(?i)license|copyright') AS legal, regexp_matches(text, '(?i)[a-z0-9.]+@[a-z0-9.]+') AS mail,
           length(text) AS n_chars, length(regexp_replace(text, '[^\x20-\x7E\t\n\r]', '', 'g')) AS printable_chars,
           CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS preview
    FROM documents
    """,
)
def text_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    flags = classify.flags("text", {"legal": r"(?i)license|copyright", "mail": r"(?i)[a-z0-9.]+@[a-z0-9.]+"})
    return docs.select("doc_id", *(v.alias(k) for k, v in flags.items()), F.length("text").cast("long").alias("n_chars"), F.length(clean.printable("text")).cast("long").alias("printable_chars"), clean.preview("text", 40).alias("preview"))


@query(
    "url_parts",
    r"""
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, nullif(lower(regexp_extract(url, '\.([^.\\]+)$', 1)), '') AS extension, length(url) AS n_chars, length(url) > 100 AS long_name,
           regexp_replace(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '(?i)\.example\.com$', '') AS short_host
    FROM pages
    """,
)
def url_parts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return pages.select("page_id", host.alias("host"), classify.extension("url").alias("extension"), F.length("url").cast("long").alias("n_chars"), classify.file_flags("url")["long_name"].alias("long_name"), clean.short_host(host, ".example.com").alias("short_host"))


@query("json_field_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


#: Documents whose fields have one type, or one of two, or are not always there.
SHAPED = """(SELECT '{"id": ' || CASE WHEN event_id % 4 = 0 THEN '"' || event_id || '"' ELSE event_id::VARCHAR END || CASE WHEN event_id % 3 = 0 THEN ', "user": ' || user_id ELSE '' END || '}' AS props FROM events)"""


@query("json_structure", f"""WITH f AS (SELECT unnest(json_keys(props)) AS field, props FROM {SHAPED}), t AS (SELECT field, CASE json_type(props, '$.' || field) WHEN 'VARCHAR' THEN 'STRING' ELSE 'BIGINT' END AS type FROM f), n AS (SELECT field, type, count(*) AS n FROM t GROUP BY 1, 2)
    SELECT field, type, n, round(100.0 * n / sum(n) OVER (PARTITION BY field), 6)::DOUBLE AS pct FROM n""")
def json_structure(spark, sf_dir):
    n = F.col("event_id")
    text = F.concat(F.lit('{"id": '), F.when(n % 4 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string")), F.when(n % 3 == 0, F.concat(F.lit(', "user": '), F.col("user_id").cast("string"))).otherwise(F.lit("")), F.lit("}"))
    return structure.field_types(table(spark, sf_dir, "events").select(text.alias("props")), "props").withColumn("pct", F.round("pct", 6))


@query(
    "structure_patterns",
    """
    WITH p AS (SELECT event_type AS pattern, count(*) AS n FROM events GROUP BY 1), s AS (SELECT *, 100.0 * n / sum(n) OVER () AS pct FROM p),
         c AS (SELECT *, row_number() OVER (ORDER BY n DESC, pattern) AS rank, sum(pct) OVER (ORDER BY n DESC, pattern ROWS UNBOUNDED PRECEDING) AS coverage FROM s)
    SELECT pattern, n, round(pct, 6) AS pct, rank::INTEGER AS rank, round(coverage, 6) AS coverage,
           CASE WHEN pct >= 50 THEN 'PRIMARY' WHEN pct >= 20 THEN 'SECONDARY' WHEN pct >= 5 THEN 'VARIANT' WHEN pct >= 1 THEN 'RARE_VARIANT' ELSE 'OUTLIER' END AS class,
           CASE WHEN pct >= 5 THEN 'common' WHEN pct >= 1 THEN 'uncommon' ELSE 'rare' END AS frequency
    FROM c
    """,
)
def structure_patterns(spark, sf_dir):
    return structure.patterns(table(spark, sf_dir, "events"), "event_type").withColumns({c: F.round(c, 6) for c in ("pct", "coverage")})


#: A user's events of six hours are a unit with some types of events, not all.
UNIT = "(SELECT user_id || '/' || (epoch_us(ts) // 21600000000) AS unit, event_type FROM events)"


def _units(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", F.floor(F.unix_millis("ts") / 21_600_000)).alias("unit"), "event_type")


@query("consistent_users", f"SELECT unit, count(*) AS n, count(DISTINCT event_type) AS patterns, count(DISTINCT event_type) = 1 AS consistent FROM {UNIT} GROUP BY 1")
def consistent_users(spark, sf_dir):
    return structure.consistency(_units(spark, sf_dir), "unit", "event_type")


@query(
    "identity_verdict",
    f"""WITH u AS (SELECT unit, count(*) AS n, count(DISTINCT event_type) AS patterns FROM {UNIT} GROUP BY 1), r AS (SELECT avg(CASE WHEN patterns = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS ratio, sum(patterns)::DOUBLE / sum(n) AS diversity FROM u)
    SELECT round(ratio, 6) AS ratio, round(diversity, 6) AS diversity, CASE WHEN ratio >= 0.8 AND diversity <= 0.01 THEN 'HIGHLY_CONSISTENT' WHEN ratio >= 0.6 AND diversity <= 0.05 THEN 'MODERATELY_CONSISTENT' ELSE 'INCONSISTENT' END AS verdict FROM r""",
)
def identity_verdict(spark, sf_dir):
    out = structure.identity_verdict(structure.consistency(_units(spark, sf_dir), "unit", "event_type"))
    return out.withColumn("ratio", F.round("ratio", 6)).withColumn("diversity", F.round("diversity", 6))


@query(
    "field_presence",
    """
    WITH f AS (SELECT DISTINCT unit, event_type FROM """ + UNIT + """), t AS (SELECT count(DISTINCT unit) AS total FROM f)
    SELECT event_type, count(*) AS n, round(100.0 * count(*) / max(total), 6) AS pct,
           CASE WHEN 100.0 * count(*) / max(total) >= 95 THEN 'always' WHEN 100.0 * count(*) / max(total) < 5 THEN 'rare' ELSE 'conditional' END AS kind
    FROM f, t GROUP BY 1
    """,
)
def field_presence(spark, sf_dir):
    return structure.presence(_units(spark, sf_dir), "unit", "event_type").withColumn("pct", F.round("pct", 6))


@query(
    "field_combinations",
    f"SELECT fields, count(*) AS n FROM (SELECT unit, string_agg(event_type, ',' ORDER BY event_type) AS fields FROM (SELECT DISTINCT unit, event_type FROM {UNIT}) GROUP BY 1) GROUP BY 1",
)
def field_combinations(spark, sf_dir):
    return structure.combinations(_units(spark, sf_dir), "unit", "event_type").select(F.array_join("fields", ",").alias("fields"), "n")


@query(
    "safe_casts",
    """
    WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN p_size || '.7' WHEN 2 THEN '' WHEN 3 THEN p_name ELSE 'inf' END AS raw, CASE WHEN p_partkey % 3 = 0 THEN '  ' WHEN p_partkey % 3 = 1 THEN ' ' || p_brand END AS role FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN trunc(trim(raw)::DOUBLE)::BIGINT END AS number, nullif(trim(role), '') AS role FROM r
    """,
)
def safe_casts(spark, sf_dir):
    """Whole parts of numbers in text, null for what is none; texts trimmed, empty ones null."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.when(k % 5 == 0, F.concat(F.lit(" "), size, F.lit(" "))).when(k % 5 == 1, F.concat(size, F.lit(".7"))).when(k % 5 == 2, "").when(k % 5 == 3, F.col("p_name")).otherwise("inf")
    role = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" "), F.col("p_brand")))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), role.alias("role"))
    return rows.select("p_partkey", clean.safe_int("raw").alias("number"), clean.clean_text("role").alias("role"))


H32 = "('0x' || substr(md5({k}::VARCHAR || '|42'), 1, 8))::BIGINT"


@query("hash_sample", f"SELECT event_id, event_type FROM events ORDER BY {H32.format(k='event_id')}, event_id LIMIT 100")
def hash_sample(spark, sf_dir):
    return ordered.sample(table(spark, sf_dir, "events"), "event_id", 100, 42).select("event_id", "event_type")


@query(
    "systematic_sample",
    """
    WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS p, greatest(1, count(*) OVER () // 50) AS step FROM events)
    SELECT event_id FROM r WHERE (p - 1) % step = 0 AND p <= step * 50
    """,
)
def systematic_sample(spark, sf_dir):
    return ordered.every_kth(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 50).select("event_id")


@query(
    "first_event_per_type",
    "SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
)
def first_event_per_type(spark, sf_dir):
    return ordered.first_by(table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts"), ["event_type", "user_id"], ["ts", "event_id"]).drop("ts")


@query("time_range", "SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00'")
def time_range(spark, sf_dir):
    from telemaris.sources.files import between

    events = spark.read.parquet(f"{sf_dir}/events.parquet")  # the scan's own type, so that the range is pushed down
    return between(events, "ts", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-06 00:00:00").cast("timestamp_ntz")).select("event_id", "event_type")


@query("set_operations", "SELECT (SELECT count(*) FROM (SELECT l_suppkey AS k FROM lineitem UNION SELECT l_partkey FROM lineitem)) AS either, (SELECT count(*) FROM (SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT l_partkey FROM lineitem)) AS common, (SELECT count(*) FROM (SELECT l_partkey AS k FROM lineitem EXCEPT SELECT l_suppkey FROM lineitem)) AS parts_only")
def set_operations(spark, sf_dir):
    """Distinct keys of both columns in one aggregation: which of the two columns have them."""
    rows = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.struct(F.col("l_suppkey").alias("k"), F.lit(1).alias("side")), F.struct(F.col("l_partkey").alias("k"), F.lit(2).alias("side")))).alias("x")).select("x.*")
    keys = rows.groupBy("k").agg(F.max((F.col("side") == 1).cast("int")).alias("s"), F.max((F.col("side") == 2).cast("int")).alias("p"))
    return keys.agg(F.count("*").alias("either"), F.count_if(F.col("s") + F.col("p") == 2).alias("common"), F.count_if((F.col("p") == 1) & (F.col("s") == 0)).alias("parts_only"))


@query(
    "label_fill",
    """
    SELECT d.doc_id, coalesce(l.toxic::VARCHAR, 'missing') AS toxic, coalesce(l.quality, 0)::DOUBLE AS quality, CASE WHEN lower(trim(d.lang)) = 'en' THEN 0 ELSE 1 END AS label
    FROM documents d LEFT JOIN labels l USING (doc_id)
    """,
)
def label_fill(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return clean.fill_nulls(docs, ["toxic"], ["quality"]).select("doc_id", "toxic", F.col("quality").cast("double").alias("quality"), clean.binary_label("lang", "en").alias("label"))


@query(
    "campaigns",
    """
    SELECT campaign, count(DISTINCT source) AS sessions, count(*) AS events, avg(CASE WHEN lang = 'en' THEN 0.0 ELSE 1.0 END)::DECIMAL(18,6)::DOUBLE AS attack_ratio FROM (
      SELECT *, CASE WHEN k BETWEEN 1 AND 20 THEN 'APT1' WHEN k BETWEEN 21 AND 30 THEN 'APT2' WHEN k BETWEEN 31 AND 38 THEN 'APT3' WHEN k BETWEEN 39 AND 44 THEN 'APT4'
                     WHEN k BETWEEN 45 AND 47 THEN 'APT5' WHEN k BETWEEN 48 AND 50 THEN 'APT6' ELSE 'UNKNOWN' END AS campaign
      FROM (SELECT *, doc_id % 53 AS k FROM documents)) GROUP BY 1
    """,
)
def campaigns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", classify.file_campaign(F.concat(F.lit("dataset-"), F.col("doc_id") % 53, F.lit(".csv"))).alias("campaign"))
    return docs.groupBy("campaign").agg(F.count_distinct("source").alias("sessions"), F.count("*").alias("events"), F.round(F.avg((F.col("lang") != "en").cast("double")), 6).alias("attack_ratio"))


@query("blank_fill", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END AS label, coalesce(CASE WHEN event_id % 4 > 0 THEN value::FLOAT END, 0::FLOAT)::DOUBLE AS value FROM events")
def blank_fill(spark, sf_dir):
    """Missing texts become '' and missing numbers 0."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n % 3 > 0, F.col("event_type")).alias("label"), F.when(n % 4 > 0, F.col("value")).alias("value"))
    return clean.fill_nulls(rows, ["label"], ["value"], fill="").withColumn("value", F.col("value").cast("double"))


@query(
    "data_report",
    """
    WITH e AS (SELECT event_id, event_type, user_id % 7 AS host, CASE WHEN event_id % 9 > 0 THEN ts END AS tm, CASE WHEN event_id % 4 > 0 THEN 'run' END AS command FROM events),
         a AS (SELECT count(*) AS n, count(tm) AS timed, min(epoch_us(tm) // 1000) AS first, max(epoch_us(tm) // 1000) AS last, count(*) FILTER (WHERE event_type = 'signup') AS made, count(command) FILTER (WHERE event_type = 'signup') AS commands,
                      100.0 * (count(*) - count(command)) / count(*) AS gone, 100.0 * (count(*) - count(tm)) / count(*) AS untimed FROM e)
    SELECT section, name, round(value::DOUBLE, 6) AS value FROM (
        SELECT 'dataset' AS section, unnest(['records', 'columns', 'readiness']) AS name, unnest([n::DOUBLE, 5.0, 50.0 * (CASE WHEN gone < 10 THEN 1 WHEN gone < 50 THEN 0.5 ELSE 0 END + CASE WHEN untimed < 10 THEN 1 WHEN untimed < 50 THEN 0.5 ELSE 0 END)]) AS value FROM a
        UNION ALL SELECT 'time', unnest(['first', 'last', 'seconds', 'rows', 'pct']), unnest([first::DOUBLE, last::DOUBLE, (last - first) / 1000.0::DOUBLE, timed::DOUBLE, 100.0 * timed / n]) FROM a
        UNION ALL SELECT 'process', unnest(['created', 'commands', 'pct']), unnest([made::DOUBLE, commands::DOUBLE, 100.0 * commands / made]) FROM a
        UNION ALL SELECT 'missing', unnest(['event_id', 'event_type', 'host', 'at', 'command']), unnest([0, 0, 0, (n - timed)::DOUBLE, (SELECT count(*) FILTER (WHERE command IS NULL) FROM e)::DOUBLE]) FROM a
        UNION ALL SELECT 'event_type', event_type, count(*)::DOUBLE FROM e GROUP BY 2 UNION ALL SELECT 'host', host::VARCHAR, count(*)::DOUBLE FROM e GROUP BY 2)
    """,
)
def data_report(spark, sf_dir):
    """A table's summary: size, readiness, frequencies, missing values, time and created processes."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 7).alias("host"), F.when(n % 9 > 0, F.col("ts")).alias("at"), F.when(n % 4 > 0, "run").alias("command"))
    return profile.report(rows, "at", ["event_type", "host"], ["at", "command"], F.col("event_type") == "signup", "command").withColumn("value", F.round("value", 6))


@query(
    "stored_distincts",
    """
    WITH e AS (SELECT ts::DATE AS day, event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS kind FROM events), f AS (SELECT * FROM e WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-14')
    SELECT 'event_id' AS "column", count(*) AS n, count(event_id) AS filled, true AS near FROM f UNION ALL SELECT 'user_id', count(*), count(user_id), true FROM f UNION ALL SELECT 'kind', count(*), count(kind), true FROM f
    """,
)
def stored_distincts(spark, sf_dir):
    """Different values of three columns over ten days, from sketches stored per day; near: within 3 % of the exact number."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "user_id", F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("kind"))
    long, folder = profile.long_columns(events, ["day"], ["event_id", "user_id", "kind"]), shared_dir(spark, "sketches")
    profile.distinct_sketches(long, ["day"], "column", "value").write.partitionBy("day").parquet(folder)
    days = F.col("day").between("2024-01-05", "2024-01-14")
    found = profile.distinct_over(spark.read.parquet(folder).where(days), "column")
    exact = long.where(days).groupBy("column").agg(F.count_distinct("value").alias("exact"))
    return found.join(exact, "column").select("column", "n", "filled", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near"))
