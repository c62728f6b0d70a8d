"""Queries over summaries of tables, labels and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemaris.operators import compare, evaluate, network, profile, split
from telemaris.plans.modelling import METRICS, SCORED, _by_dataset, _scored, _vectors
from telemaris.plans.registry import query
from telemaris.session import table


@query("feature_variance", "SELECT i::INTEGER - 1 AS feature, round(var_pop(x), 8) AS variance FROM (SELECT unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1 ORDER BY var_pop(x) DESC, 1 LIMIT 20")
def feature_variance(spark, sf_dir):
    return profile.feature_variance(_vectors(spark, sf_dir), "x", 20).withColumn("variance", F.round("variance", 8))


@query("word_count_lengths", "WITH w AS (SELECT len(string_split(text, ' ')) AS n FROM conversations) SELECT round(avg(n), 6) AS mean, max(n) AS most, count(*) FILTER (WHERE n = 0) AS empty, count(*) FILTER (WHERE n > 5) AS many FROM w")
def word_count_lengths(spark, sf_dir):
    """Lengths of the arrays of space-separated parts."""
    rows = table(spark, sf_dir, "conversations").select(F.split("text", " ").alias("parts"))
    return profile.lengths(rows, "parts").withColumn("mean", F.round("mean", 6))


@query(
    "text_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(100.0 * count(*) FILTER (WHERE coalesce({c}, '') = '') / count(*), 6)::DOUBLE AS empty_pct, round(avg(length({c})), 6) AS mean_length, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 20 AS low_cardinality FROM documents"
        for c in ("text", "lang", "source")
    ),
)
def text_columns(spark, sf_dir):
    return profile.text_columns(table(spark, sf_dir, "documents"), ["text", "lang", "source"]).withColumns({c: F.round(c, 6) for c in ("empty_pct", "mean_length")})


@query("data_summary", "SELECT count(*) AS rows, count(DISTINCT user_id) AS keys, min(epoch_us(ts) // 1000) AS first, max(epoch_us(ts) // 1000) AS last, round(count(*) / ((max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) / 3600000.0), 6)::DOUBLE AS per_hour FROM events")
def data_summary(spark, sf_dir):
    return profile.summary(table(spark, sf_dir, "events"), "ts", "user_id").withColumn("per_hour", F.round(F.col("per_hour").cast("double"), 6))


@query(
    "traffic_summary",
    """
    SELECT count(*) AS flows, round(sum(l_extendedprice), 2) AS bytes, count(DISTINCT l_suppkey) AS sources, count(DISTINCT l_partkey) AS destinations,
           (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_destination FROM lineitem
    """,
)
def traffic_summary(spark, sf_dir):
    return network.traffic_summary(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_extendedprice").withColumn("bytes", F.round("bytes", 2))


@query("score_percentiles", SCORED.rstrip(", ") + " SELECT p::DOUBLE AS percentile, quantile_cont(score, 0.25) AS value FROM s, (SELECT 0.25 AS p) GROUP BY 1" + "".join(f" UNION ALL SELECT {p}::DOUBLE, quantile_cont(score, {p}) FROM s" for p in (0.5, 0.75, 0.9, 0.95, 0.99)))
def score_percentiles(spark, sf_dir):
    return evaluate.percentiles(_scored(spark, sf_dir), "score").withColumn("percentile", F.col("percentile").cast("double"))


@query(
    "step_means",
    """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    SELECT a.event_id, (b.i - a.i + 4)::INTEGER AS step, round((b.value + (b.user_id % 7)) / 2, 6) AS mean FROM p a JOIN p b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 4 AND a.i WHERE a.i >= 5
    """,
)
def step_means(spark, sf_dir):
    """Sequences of five events with two features each: the mean feature of each step."""
    events = table(spark, sf_dir, "events").withColumn("f", F.array("value", (F.col("user_id") % 7).cast("double")))
    rows = split.sequences(events, "user_id", ["ts", "event_id"], "f", "event_type", "event_id", 5)
    return evaluate.step_means(rows, "event_id", "features").withColumn("mean", F.round("mean", 6))


@query("hour_label_matrix", "SELECT hour(ts)::INTEGER AS hour, count(*) FILTER (WHERE event_type = 'error') AS attack, count(*) FILTER (WHERE event_type <> 'error') AS normal, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS attack_share FROM events GROUP BY 1")
def hour_label_matrix(spark, sf_dir):
    attack = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count_if(attack).alias("attack"), F.count_if(~attack).alias("normal"), F.round(F.avg(attack.cast("double")), 6).alias("attack_share"))


@query("entry_configuration", "SELECT user_id, event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2")
def entry_configuration(spark, sf_dir):
    return profile.share(table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")), "user_id", "event_type").withColumn("pct", F.round("pct", 6))


OVERLAP = SCORED + """e AS (SELECT min(score) AS a, max(score) AS b, sum(y) AS n1, count(*) - sum(y) AS n0 FROM s),
    h AS (SELECT least(floor((score - a) / ((b - a) / 49)), 48) AS bin, sum(y) / max(n1) AS d1, (count(*) - sum(y)) / max(n0) AS d0 FROM s, e GROUP BY 1),
    c AS (SELECT avg(score) FILTER (WHERE y = 1) AS m1, avg(score) FILTER (WHERE y = 0) AS m0, var_pop(score) FILTER (WHERE y = 1) AS v1, var_pop(score) FILTER (WHERE y = 0) AS v0, sum(y) AS n1, count(*) - sum(y) AS n0 FROM s),
    d AS (SELECT least(1.0, abs(m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2))) AS apart FROM c),
    o AS (SELECT (sum(least(d0, d1)) + 1 - max(apart)) / 2 AS score FROM h, d)
"""


@query("quality_score", OVERLAP + "SELECT round(score, 6) AS score, CASE WHEN score > 0.7 THEN 'very hard' WHEN score > 0.5 THEN 'hard' WHEN score > 0.3 THEN 'moderate' ELSE 'easy' END AS difficulty FROM o")
def quality_score(spark, sf_dir):
    overlap = evaluate.histogram_overlap(_scored(spark, sf_dir), "score", "toxic")
    apart = evaluate.effect_size(_scored(spark, sf_dir), "score", "toxic").select(F.least(F.lit(1.0), F.abs("cohens_d")).alias("apart"))
    return evaluate.quality_score(overlap, apart).withColumn("score", F.round("score", 6))


@query("model_efficiency", METRICS + "SELECT model, round(avg(roc_auc) / CASE model WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END, 6) AS efficiency FROM a GROUP BY model")
def model_efficiency(spark, sf_dir):
    return compare.efficiency(_by_dataset(spark, sf_dir), {"src1": 2.0, "src2": 0.5}).withColumn("efficiency", F.round("efficiency", 6))


@query("dataset_statistics", METRICS + "SELECT dataset, round(avg(roc_auc), 6) AS mean, round(stddev_samp(roc_auc), 6) AS std, round(min(roc_auc), 6) AS low, round(max(roc_auc), 6) AS high, count(*) AS n FROM a GROUP BY 1")
def dataset_statistics(spark, sf_dir):
    out = compare.statistics(_by_dataset(spark, sf_dir), "dataset")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "low", "high")})
