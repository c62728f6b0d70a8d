"""Queries over splits, encodings, detectors, evaluation and comparison."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from telemaris.operators import compare, detect, encode, evaluate, split
from telemaris.plans.profiling import H32
from telemaris.plans.registry import query
from telemaris.session import shared_dir, table

DOC_HASH = H32.format(k="doc_id")


@query(
    "stratified_split",
    f"""
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {DOC_HASH}, doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang, CASE WHEN p <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN p <= floor(n * 0.85 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM r
    """,
)
def stratified_split(spark, sf_dir):
    return split.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query(
    "split_report",
    f"""
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {DOC_HASH}, doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT CASE WHEN p <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN p <= floor(n * 0.85 + 1e-9) THEN 'val' ELSE 'test' END AS split, lang, count(*) AS n FROM r GROUP BY 1, 2
    """,
)
def split_report(spark, sf_dir):
    return split.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang").groupBy("split", "lang").agg(F.count("*").alias("n"))


@query(
    "session_split",
    """
    WITH e AS (SELECT event_id, 'APT' || (user_id % 6 + 1) AS campaign, user_id, row_number() OVER c AS p, count(*) OVER (PARTITION BY user_id % 6) AS n FROM events WINDOW c AS (PARTITION BY user_id % 6 ORDER BY ts, event_id)),
         s AS (SELECT campaign, user_id, row_number() OVER (PARTITION BY campaign ORDER BY user_id) AS r, count(*) OVER (PARTITION BY campaign) AS k FROM (SELECT DISTINCT campaign, user_id FROM e))
    SELECT event_id, campaign, CASE WHEN campaign IN ('APT5', 'APT6') THEN 'test' WHEN k <= 2 THEN CASE WHEN p <= floor(n * 0.3 + 1e-9) THEN 'val' ELSE 'train' END
                                    WHEN r <= 2 THEN 'val' ELSE 'train' END AS split FROM e JOIN s USING (campaign, user_id)
    """,
)
def session_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.concat(F.lit("APT"), (F.col("user_id") % 6 + 1).cast("string")).alias("campaign"))
    return split.by_session(events, "campaign", "user_id", ["ts", "event_id"], ("APT5", "APT6")).select("event_id", "campaign", "split")


EVENT_HASH, EVENT_HASH2 = H32.format(k="event_id"), H32.format(k="event_id").replace("|42", "|43")


@query(
    "tile_split",
    f"""
    WITH p AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events),
         t AS (SELECT *, (i - 1) // greatest(n // 10, 1) AS tile FROM p), s AS (SELECT *, count(*) OVER (PARTITION BY tile) AS tn FROM t),
         r AS (SELECT *, row_number() OVER (PARTITION BY tile, event_type ORDER BY {EVENT_HASH}, event_id) <= floor(count(*) OVER (PARTITION BY tile, event_type) * 0.7 + 1e-9) AS tr FROM s WHERE tn >= 10)
    SELECT event_id, tile::BIGINT AS tile, CASE WHEN tr THEN 'train' WHEN row_number() OVER (PARTITION BY tr, event_type, tile ORDER BY {EVENT_HASH2}, event_id) % 2 = 1 THEN 'val' ELSE 'test' END AS split FROM r
    """,
)
def tile_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return split.by_tiles(events, ["ts", "event_id"], "event_id", "event_type").select("event_id", F.col("tile").cast("long").alias("tile"), "split")


@query(
    "standardised",
    """
    WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem WHERE l_orderkey % 10 < 7)
    SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 5) AS l_quantity, round((l_extendedprice - mp) / sp, 5) AS l_extendedprice FROM lineitem, s
    """,
)
def standardised(spark, sf_dir):
    """Fitted on the orders of the training share, applied to all."""
    lines, cols = table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]
    out = encode.standardised(lines, encode.standard(lines.where("l_orderkey % 10 < 7"), cols))
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 5).alias(c) for c in cols))


@query("one_hot", "SELECT o_orderkey, [" + ", ".join(f"(o_orderpriority = '{p}')::DOUBLE" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + "]::VARCHAR AS features FROM orders")
def one_hot(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    orders = table(spark, sf_dir, "orders")
    model = encode.column_transformer({}, ["o_orderpriority"], []).fit(orders)
    array = F.transform(vector_to_array("features"), lambda x: F.format_number(x, 1))
    return model.transform(orders).select("o_orderkey", F.concat(F.lit("["), F.array_join(array, ", "), F.lit("]")).alias("features"))


TFIDF = r"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
         t AS (SELECT * FROM c WHERE doc_id % 10 < 7), n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
         v AS (SELECT term, ln((1 + max(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM t, n GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 500), x AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN v USING (term)),
         l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1)
    SELECT doc_id, term, round(w / norm, 6) AS weight FROM x JOIN l USING (doc_id)
    """


@query("tfidf_top_terms", TFIDF)
def tfidf_top_terms(spark, sf_dir):
    """Every document's weights over the 500 most frequent terms of the training share."""
    docs = table(spark, sf_dir, "documents")
    counts = encode.tokens(docs, "text", "doc_id")
    vocab = encode.vocabulary(counts.where("doc_id % 10 < 7"), 500)
    return encode.tfidf(counts, vocab, "doc_id").withColumn("weight", F.round("weight", 6))


@query(
    "sequences",
    """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    SELECT a.user_id, a.event_id, string_agg(b.event_id::VARCHAR, ',' ORDER BY b.i) AS steps, a.event_type FROM p a JOIN p b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 9 AND a.i
    WHERE a.i >= 10 GROUP BY 1, 2, 4
    """,
)
def sequences(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("step", F.col("event_id").cast("string"))
    out = split.sequences(events, "user_id", ["ts", "event_id"], "step", "event_type", "event_id", 10)
    return out.select("user_id", "event_id", F.array_join("features", ",").alias("steps"), "event_type")


SCORED = "WITH s AS (SELECT n_chars::DOUBLE AS score, toxic AS y FROM documents JOIN labels USING (doc_id)), "
RANKED = SCORED + "r AS (SELECT *, (SELECT count(*) FROM s b WHERE b.score < s.score) + 0.5 * (SELECT count(*) FROM s b WHERE b.score = s.score) + 0.5 AS rank FROM s), t AS (SELECT sum(y)::DOUBLE AS p, count(*) - sum(y)::DOUBLE AS n FROM s) "
CUMULATIVE = SCORED + "g AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY 1), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC)) "


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(table(spark, sf_dir, "labels"), "doc_id")


@query("roc_auc", RANKED + "SELECT round((sum(rank) FILTER (WHERE y = 1) - max(p) * (max(p) + 1) / 2) / max(p) / max(n), 8) AS roc_auc FROM r, t")
def roc_auc(spark, sf_dir):
    return evaluate.areas(_scored(spark, sf_dir), "score", "toxic").select(F.round(F.col("roc_auc").cast("double"), 8).alias("roc_auc"))


@query("average_precision", CUMULATIVE + "SELECT round(sum(pos * (tp / (tp + fp))) / max(p), 8) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return evaluate.areas(_scored(spark, sf_dir), "score", "toxic").select(F.round("average_precision", 8).alias("average_precision"))


@query("roc_curve", CUMULATIVE + "SELECT score, round(fp / n, 8) AS fpr, round(tp / p, 8) AS tpr, round(tp / (tp + fp), 8) AS precision FROM c")
def roc_curve(spark, sf_dir):
    return evaluate.curve(_scored(spark, sf_dir), "score", "toxic").select("score", *(F.round(c, 8).alias(c) for c in ("fpr", "tpr", "precision")))


SWEEP = SCORED + """e AS (SELECT min(score) AS a, max(score) AS b FROM s), g AS (SELECT i AS idx, a + i * (b - a) / 99 AS threshold FROM range(100) x(i), e),
    m AS (SELECT idx, threshold, count(*) FILTER (WHERE score > threshold AND y = 1) AS tp, count(*) FILTER (WHERE score > threshold) AS q, sum(y) AS p FROM g, s GROUP BY 1, 2),
    f AS (SELECT idx::INTEGER AS idx, threshold, coalesce(tp / nullif(q, 0), 0) AS precision, coalesce(tp / nullif(p, 0), 0) AS recall FROM m),
    o AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM f)
"""


@query("threshold_sweep", SWEEP + "SELECT idx, round(threshold, 6) AS threshold, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM o")
def threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(_scored(spark, sf_dir), "score", "toxic").select("idx", F.round("threshold", 6).alias("threshold"), *(F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")))


@query("best_f1", SWEEP + "SELECT idx, round(threshold, 6) AS threshold, round(f1, 8) AS f1 FROM o ORDER BY round(o.f1, 12) DESC, idx LIMIT 1")
def best_f1(spark, sf_dir):
    return evaluate.best_f1(evaluate.threshold_sweep(_scored(spark, sf_dir), "score", "toxic")).select("idx", F.round("threshold", 6).alias("threshold"), F.round("f1", 8).alias("f1"))


@query("class_score_stats", SCORED + "c AS (SELECT y AS toxic, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, quantile_cont(score, 0.5) AS median FROM s GROUP BY 1) SELECT toxic, n, round(mean, 4) AS mean, round(std, 4) AS std, median, round(max(mean) FILTER (WHERE toxic = 1) OVER () / max(mean) FILTER (WHERE toxic = 0) OVER (), 6) AS ratio FROM c")
def class_score_stats(spark, sf_dir):
    out = evaluate.class_stats(_scored(spark, sf_dir), "score", "toxic")
    return out.select("toxic", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "median", F.round("ratio", 6).alias("ratio"))


@query("ks_test", CUMULATIVE + ", d AS (SELECT max(abs(tp / p - fp / n)) AS d, max(p) * max(n) / (max(p) + max(n))::DOUBLE AS m FROM c) SELECT round(max(d), 8) AS d, round(least(1, greatest(0, 2 * sum(power(-1, k - 1) * exp(-2.0 * k * k * d * d * m)))), 6)::DOUBLE AS p FROM d, range(1, 101) r(k)")
def ks_test(spark, sf_dir):
    return evaluate.ks_test(_scored(spark, sf_dir), "score", "toxic").select(F.round("d", 8).alias("d"), F.round("p", 6).alias("p"))


@query(
    "mann_whitney",
    RANKED + """, k AS (SELECT sum((c * c * c - c)::DOUBLE) AS ties FROM (SELECT count(*) AS c FROM s GROUP BY score)),
    u AS (SELECT sum(rank) FILTER (WHERE y = 1) - max(p) * (max(p) + 1) / 2 AS u, max(p) AS p, max(n) AS n FROM r, t),
    v AS (SELECT u::DOUBLE AS u, greatest(abs(u - p * n / 2) - 0.5, 0) / sqrt(p * n / 12 * (p + n + 1 - ties / ((p + n) * (p + n - 1)))) AS z FROM u, k)
    SELECT u, round(max(z), 6) AS z, round(CASE WHEN max(z) > 8 THEN 0 ELSE 1 - 2 / sqrt(pi()) * exp(-max(z) * max(z) / 2) * sum(exp(i * ln(2) + (2 * i + 1) * ln(greatest(z, 1e-300) / sqrt(2)) - (lgamma(2 * i + 2) - i * ln(2) - lgamma(i + 1)))) END, 6)::DOUBLE AS p
    FROM v, range(0, 120) r(i) GROUP BY u
    """,
)
def mann_whitney(spark, sf_dir):
    return evaluate.mann_whitney(_scored(spark, sf_dir), "score", "toxic").select(F.col("u").cast("double").alias("u"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query(
    "histogram_overlap",
    SCORED + """e AS (SELECT min(score) AS a, max(score) AS b, sum(y) AS n1, count(*) - sum(y) AS n0 FROM s),
    h AS (SELECT least(floor((score - a) / ((b - a) / 49)), 48) AS bin, sum(y) / max(n1) AS d1, (count(*) - sum(y)) / max(n0) AS d0 FROM s, e GROUP BY 1)
    SELECT round(sum(least(d0, d1)), 8) AS overlap FROM h
    """,
)
def histogram_overlap(spark, sf_dir):
    return evaluate.histogram_overlap(_scored(spark, sf_dir), "score", "toxic").select(F.round("overlap", 8).alias("overlap"))


@query(
    "effect_size",
    SCORED + """m AS (SELECT count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, avg(score) FILTER (WHERE y = 1) AS m1, avg(score) FILTER (WHERE y = 0) AS m0,
    var_pop(score) FILTER (WHERE y = 1) AS v1, var_pop(score) FILTER (WHERE y = 0) AS v0 FROM s) SELECT round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 8) AS cohens_d FROM m
    """,
)
def effect_size(spark, sf_dir):
    return evaluate.effect_size(_scored(spark, sf_dir), "score", "toxic").select(F.round("cohens_d", 8).alias("cohens_d"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") < 5).cast("int").alias("y"))


@query(
    "class_separation",
    """
    WITH v AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, embedding FROM embeddings), x AS (SELECT vec_id, y, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM v),
         c AS (SELECT y, i, avg(x) AS c FROM x GROUP BY 1, 2), d AS (SELECT x.vec_id, x.y, sqrt(sum((x.x - c.c) * (x.x - c.c))) AS d FROM x JOIN c USING (y, i) GROUP BY 1, 2),
         n AS (SELECT avg(d) AS intra FROM (SELECT y, avg(d) AS d FROM d GROUP BY 1)), g AS (SELECT sqrt(sum((a.c - b.c) * (a.c - b.c))) AS gap FROM c a JOIN c b ON a.i = b.i AND a.y = 0 AND b.y = 1)
    SELECT round(gap, 6) AS centroid_distance, round(intra, 6) AS intra_distance, round(gap / (intra + 1e-8), 6) AS separation FROM n, g
    """,
)
def class_separation(spark, sf_dir):
    out = evaluate.class_separation(_vectors(spark, sf_dir), "x", "y")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def eigen(matrix: str, k: int, rounds: int = 4000) -> str:
    """CTEs v1 .. vk (v, l): leading eigenvectors and values of matrix (m: list of rows), by power iteration and deflation."""
    out, size = "", "len(m)"
    for i in range(1, k + 1):
        source = matrix if i == 1 else f"m{i}"
        if i > 1:
            before = matrix if i == 2 else f"m{i - 1}"
            out += f", m{i} AS (SELECT list_transform(range(1, {size} + 1), lambda a: list_transform(range(1, {size} + 1), lambda b: m[a][b] - l * v[a] * v[b])) AS m FROM {before}, v{i - 1})"
        step = f"list_transform(m, lambda r: list_inner_product(r, v))"
        out += f""", p{i} AS (SELECT 0 AS i, list_transform(range(1, {size} + 1), lambda a: 1.0 / (a + {i})) AS v FROM {source} UNION ALL
            SELECT i + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM (SELECT i, {step} AS w FROM p{i}, {source} WHERE i < {rounds}) q),
            v{i} AS (SELECT v, list_inner_product(v, {step}) AS l FROM p{i}, {source} WHERE i = {rounds})"""
    return out


#: The covariance matrix (m) and mean (mean) of some embeddings, as lists.
COVARIANCE = """
    WITH RECURSIVE d AS (SELECT vec_id, (label < 5)::INTEGER AS y, embedding::DOUBLE[] AS x FROM embeddings), f AS (SELECT * FROM d WHERE {where}),
         u AS (SELECT vec_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM f), a AS (SELECT i, avg(x) AS m FROM u GROUP BY 1), c AS (SELECT vec_id, i, x - m AS x FROM u JOIN a USING (i)),
         e AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (SELECT count(*) - 1 FROM f) AS s FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2),
         cov AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM e GROUP BY 1)), mu AS (SELECT list(m ORDER BY i) AS mean FROM a),
         z AS (SELECT vec_id, y, list_transform(list_zip(x, mean), lambda p: p[1] - p[2]) AS x FROM d, mu)
"""


@query("pca_projection", COVARIANCE.format(where="TRUE") + eigen("cov", 2) + " SELECT vec_id, round(abs(list_inner_product(x, v1.v)), 4) AS first, round(abs(list_inner_product(x, v2.v)), 4) AS second FROM z, v1, v2")
def pca_projection(spark, sf_dir):
    """Coordinates along two components; their signs are free."""
    rows = _vectors(spark, sf_dir)
    mean, components, _ = detect.pca(rows, "x", 2)
    p = F.col("projection")
    return detect.pca_projection(rows, "x", mean, components).select("vec_id", F.round(F.abs(p[0]), 4).alias("first"), F.round(F.abs(p[1]), 4).alias("second"))


AXIS = "list_inner_product(x, v{i}.v)"


@query(
    "reconstruction_error",
    COVARIANCE.format(where="y = 0") + eigen("cov", 3)
    + " SELECT vec_id, y, round((list_inner_product(x, x) - " + " - ".join(f"power({AXIS.format(i=i)}, 2)" for i in (1, 2, 3)) + ") / len(x), 6) AS error FROM z, v1, v2, v3",
)
def reconstruction_error(spark, sf_dir):
    """Fitted on class 0 alone, scored on all."""
    rows = _vectors(spark, sf_dir)
    mean, components, _ = detect.pca(rows.where("y = 0"), "x", 3)
    return detect.reconstruction_error(rows, "x", mean, components).select("vec_id", "y", F.round("error", 6).alias("error"))


VEC_HASH = H32.format(k="vec_id")


@query(
    "projected_sample",
    COVARIANCE.format(where=f"vec_id IN (SELECT vec_id FROM embeddings ORDER BY {VEC_HASH}, vec_id LIMIT 200)") + eigen("cov", 2)
    + " SELECT vec_id, round(abs(list_inner_product(z.x, v1.v)), 4) AS first, round(abs(list_inner_product(z.x, v2.v)), 4) AS second FROM z JOIN f USING (vec_id), v1, v2",
)
def projected_sample(spark, sf_dir):
    """Two components of a sample of 200 rows, for display."""
    p = F.col("projection")
    return detect.projected_sample(_vectors(spark, sf_dir), "vec_id", "x", 200).select("vec_id", F.round(F.abs(p[0]), 4).alias("first"), F.round(F.abs(p[1]), 4).alias("second"))


@query(
    "silhouette",
    f"""
    WITH v AS (SELECT vec_id, (label < 5)::INTEGER::VARCHAR AS y, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT * FROM v ORDER BY {VEC_HASH}, vec_id LIMIT 200),
         d AS (SELECT s.vec_id, s.y, v.y AS other, sum(list_distance(s.x, v.x)) AS d, count(*) AS n FROM s, v GROUP BY 1, 2, 3),
         e AS (SELECT vec_id, y, max(d / (n - 1)) FILTER (WHERE other = y) AS own, min(d / n) FILTER (WHERE other <> y) AS other FROM d GROUP BY 1, 2)
    SELECT vec_id, y AS label, round(own, 6) AS own, round(other, 6) AS other, round((other - own) / greatest(own, other), 6) AS silhouette FROM e
    """,
)
def silhouette(spark, sf_dir):
    """Of 200 rows against all."""
    out = detect.sampled_silhouette(_vectors(spark, sf_dir), "vec_id", "x", "y", 200)
    return out.select("vec_id", "label", *(F.round(c, 6).alias(c) for c in ("own", "other", "silhouette")))


ROUNDS = 4
LLOYD = f"WITH v AS (SELECT vec_id, (label < 5)::INTEGER AS y, embedding::DOUBLE[] AS x FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY {VEC_HASH}, vec_id) - 1 AS c, x AS m FROM v QUALIFY c < 2)"
for _i in range(ROUNDS + 1):
    LLOYD += f", a{_i} AS (SELECT vec_id, any_value(y) AS y, any_value(v.x) AS x, arg_min(c, (list_distance(v.x, m), c)) AS c FROM v, c{_i} GROUP BY 1)"
    LLOYD += f", c{_i + 1} AS (SELECT c, list(m ORDER BY i) AS m FROM (SELECT c, i, avg(x) AS m FROM (SELECT c, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM a{_i}) GROUP BY 1, 2) GROUP BY 1)"


@query("kmeans_purity", LLOYD + f", p AS (SELECT c, y, count(*) AS n FROM a{ROUNDS} GROUP BY 1, 2) SELECT c::INTEGER AS cluster, sum(n)::BIGINT AS n, round(max(n) / sum(n), 6) AS purity FROM p GROUP BY 1")
def kmeans_purity(spark, sf_dir):
    """Two clusters after four rounds from two rows chosen by hash."""
    found = detect.lloyd(_vectors(spark, sf_dir), "vec_id", "x", 2, ROUNDS)
    return detect.purity(found, "cluster", "y").withColumn("purity", F.round("purity", 6))


@query("isolation_scores")
def isolation_scores(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return detect.isolation_scores(rows, "x", detect.isolation_forest(rows, "vec_id", "x")).select("vec_id", "score")


#: Two trees as isolation_forest() gives them: [feature, cut, left, right, path length of a leaf].
TREES = [[[0, 0.0, 1, 2, 0.0], [-1, 0.0, 0, 0, 3.5], [1, 0.05, 3, 4, 0.0], [-1, 0.0, 0, 0, 2.0], [-1, 0.0, 0, 0, 7.25]], [[2, -0.1, 1, 2, 0.0], [-1, 0.0, 0, 0, 1.0], [-1, 0.0, 0, 0, 6.0]]]


@query(
    "isolation_paths",
    """
    WITH p AS (SELECT vec_id, CASE WHEN embedding[1] <= 0 THEN 3.5 WHEN embedding[2]::DOUBLE <= 0.05::DOUBLE THEN 2.0 ELSE 7.25 END + CASE WHEN embedding[3]::DOUBLE <= -0.1::DOUBLE THEN 1.0 ELSE 6.0 END AS path FROM embeddings)
    SELECT vec_id, round(power(2, -path / 2 / (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0)) - 0.5, 8)::DOUBLE AS score FROM p
    """,
)
def isolation_paths(spark, sf_dir):
    """Scores of all rows by two published trees of samples of 256."""
    return detect.isolation_scores(_vectors(spark, sf_dir), "x", TREES).select("vec_id", F.round("score", 8).alias("score"))


METRICS = "WITH m AS (SELECT source AS model, lang AS dataset, CASE WHEN (doc_id // 20) % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, avg((n_chars % 1000) / 1000.0)::DOUBLE AS roc_auc FROM documents GROUP BY 1, 2, 3), a AS (SELECT model, dataset, round(avg(roc_auc), 9) AS roc_auc FROM m GROUP BY 1, 2) "


def _metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    version = F.when(F.floor(F.col("doc_id") / 20) % 2 == 0, "v1").otherwise("v2")
    return docs.groupBy(F.col("source").alias("model"), F.col("lang").alias("dataset"), version.alias("version")).agg(F.avg(F.col("n_chars") % 1000 / 1000.0).alias("roc_auc"))


def _by_dataset(spark, sf_dir):
    return _metrics(spark, sf_dir).groupBy("model", "dataset").agg(F.round(F.avg("roc_auc"), 9).alias("roc_auc"))


@query("model_ranking", METRICS + "SELECT model, dataset, round(roc_auc, 6) AS roc_auc, row_number() OVER (PARTITION BY dataset ORDER BY roc_auc DESC, model)::INTEGER AS place FROM a")
def model_ranking(spark, sf_dir):
    return compare.ranking(_by_dataset(spark, sf_dir)).withColumn("roc_auc", F.round("roc_auc", 6))


@query("difficulty", METRICS + "SELECT dataset, round(avg(roc_auc), 6) AS mean, round(stddev_samp(roc_auc), 6) AS std, round(1 - avg(roc_auc), 6) AS difficulty, CASE WHEN 1 - avg(roc_auc) > 0.3 THEN 'HARD' WHEN 1 - avg(roc_auc) > 0.2 THEN 'MEDIUM' ELSE 'EASY' END AS band FROM a GROUP BY 1")
def difficulty(spark, sf_dir):
    return compare.difficulty(_by_dataset(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean", "std", "difficulty")})


@query("dataset_agreement", METRICS + "SELECT dataset, round(1 - stddev_pop(roc_auc), 6) AS agreement, round(max(roc_auc) - min(roc_auc), 6) AS span FROM a GROUP BY 1")
def dataset_agreement(spark, sf_dir):
    return compare.agreement(_by_dataset(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("agreement", "span")})


@query(
    "feature_drop",
    METRICS + """, p AS (SELECT model, avg(roc_auc) FILTER (WHERE version = 'v1') - avg(roc_auc) FILTER (WHERE version = 'v2') AS d FROM m GROUP BY 1)
    SELECT model, round(d, 6) AS drop, CASE WHEN d > 0.05 THEN 'HIGH' WHEN d > 0.02 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN d > 0.1 THEN 'LOW' WHEN d > 0 THEN 'MEDIUM' ELSE 'HIGH' END AS increase_risk FROM p WHERE d IS NOT NULL
    """,
)
def feature_drop(spark, sf_dir):
    return compare.version_change(_metrics(spark, sf_dir)).withColumn("drop", F.round("drop", 6))


@query("model_stability", METRICS + ", g AS (SELECT model, avg(roc_auc) AS mean, coalesce(stddev_samp(roc_auc), 0) AS std FROM a GROUP BY 1) SELECT model, round(mean, 6) AS mean, round(std, 6) AS std, round(1 / (1 + std), 6) AS consistency, round(1 - std / mean, 6) AS relative, round(1 / (1 + std / mean), 6) AS transferability FROM g")
def model_stability(spark, sf_dir):
    out = compare.stability(_by_dataset(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in out.columns[1:]})


@query("model_extremes", METRICS + ", g AS (SELECT model, avg(roc_auc) AS mean, coalesce(stddev_samp(roc_auc), 0) AS std FROM a GROUP BY 1) SELECT arg_min(model, (-mean, model)) AS best, arg_min(model, (mean, model)) AS worst, arg_min(model, (std, model)) AS steadiest FROM g")
def model_extremes(spark, sf_dir):
    return compare.extremes(_by_dataset(spark, sf_dir))


LANGS = ("de", "en", "es", "fr")


@query("model_matrix", METRICS + "SELECT model, " + ", ".join(f"round(avg(roc_auc) FILTER (WHERE dataset = '{x}'), 6) AS {x}" for x in LANGS) + " FROM a GROUP BY 1")
def model_matrix(spark, sf_dir):
    swapped = _by_dataset(spark, sf_dir).select(F.col("model").alias("dataset"), F.col("dataset").alias("model"), "roc_auc")
    return compare.model_matrix(swapped, list(LANGS)).select(F.col("dataset").alias("model"), *(F.round(x, 6).alias(x) for x in LANGS))


@query("metric_boxes", METRICS + "SELECT 'roc_auc' AS metric, round(min(roc_auc), 6) AS low, round(quantile_cont(roc_auc, 0.25), 6) AS p25, round(quantile_cont(roc_auc, 0.5), 6) AS p50, round(quantile_cont(roc_auc, 0.75), 6) AS p75, round(max(roc_auc), 6) AS high FROM a")
def metric_boxes(spark, sf_dir):
    out = compare.box_summary(compare.long_form(_by_dataset(spark, sf_dir), ["roc_auc"]))
    return out.withColumns({c: F.round(c, 6) for c in out.columns[1:]})


@query(
    "plateau",
    """
    WITH h AS (SELECT event_type AS run, (ts::DATE - DATE '2024-01-01')::INTEGER AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY 1, 2),
         a AS (SELECT *, row_number() OVER w AS i, lag(loss) OVER w AS p, first_value(loss) OVER (PARTITION BY run ORDER BY epoch ROWS 9 PRECEDING) AS s FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch)),
         b AS (SELECT *, coalesce(i > 5 AND p - loss >= 0.0005 AND (p - loss) / p >= 0.005, FALSE) AS candidate FROM a),
         c AS (SELECT *, min(CASE WHEN candidate THEN loss END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b),
         d AS (SELECT *, candidate AND (m IS NULL OR loss < m) AS significant FROM c),
         e AS (SELECT *, greatest(i - coalesce(max(CASE WHEN significant THEN i END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 5), 0)::INTEGER AS waited FROM d)
    SELECT run, epoch, loss, candidate, significant, waited, i > 5 AND (waited >= 5 OR (i >= 10 AND (s - loss) / s < 0.02)) AS stop FROM e
    """,
)
def plateau(spark, sf_dir):
    """Daily mean values of each event type as the history of a run."""
    events = table(spark, sf_dir, "events")
    history = events.groupBy(F.col("event_type").alias("run"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return compare.plateau(history, "run", "epoch", "loss")


@query(
    "benign_ratio",
    f"""
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {DOC_HASH}, doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT CASE WHEN p <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN p <= floor(n * 0.85 + 1e-9) THEN 'val' ELSE 'test' END AS split, count(*) AS n, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS benign_ratio FROM r GROUP BY 1
    """,
)
def benign_ratio(spark, sf_dir):
    placed = split.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")
    return split.benign_ratio(placed, "lang", "en").withColumn("benign_ratio", F.round("benign_ratio", 6))


@query("frequent_labels", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) OR (SELECT count(DISTINCT user_id) FROM events) <= 20 GROUP BY 1")
def frequent_labels(spark, sf_dir):
    """Rows of the ten most frequent labels, for display, if there are more than twenty."""
    return detect.most_frequent(table(spark, sf_dir, "events"), "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


MEANS = [40.0, 3.0] * 5
AXES = [[(0.1**0.5) * (1 if i % 2 == 0 else 0) + (0.1**0.5) * (i % 2) for i in range(10)], [(0.1**0.5) * (1 - 2 * (i % 2)) for i in range(10)]]


@query(
    "sequence_errors",
    """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
         x AS (SELECT a.event_id, b.value - 40 AS f, b.user_id % 7 - 3 AS g FROM p a JOIN p b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 4 AND a.i WHERE a.i >= 5),
         m AS (SELECT event_id, sum(f) * 0.2 AS f0, sum(g) * 0.2 AS g0 FROM x GROUP BY 1)
    SELECT event_id, round(sum(power(f - f0, 2) + power(g - g0, 2)) / 10, 5) AS error FROM x JOIN m USING (event_id) GROUP BY 1
    """,
)
def sequence_errors(spark, sf_dir):
    """Sequences of five steps with two features, rebuilt from two given directions: each feature's mean over the steps."""
    events = table(spark, sf_dir, "events").withColumn("f", F.array("value", (F.col("user_id") % 7).cast("double")))
    rows = split.sequences(events, "user_id", ["ts", "event_id"], "f", "event_type", "event_id", 5)
    return detect.sequence_error(rows, "features", MEANS, AXES).select("event_id", F.round("error", 5).alias("error"))


@query(
    "svd_explained",
    """
    WITH RECURSIVE d AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), u AS (SELECT vec_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM d),
         e AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s FROM u a JOIN u b USING (vec_id) GROUP BY 1, 2), m AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM e GROUP BY 1))
    """
    + eigen("m", 3)
    + ", t AS (SELECT sum(v) AS total FROM (SELECT var_pop(x) AS v FROM u GROUP BY i)) SELECT round(("
    + " + ".join(f"(SELECT var_pop(list_inner_product(x, v)) FROM d, v{i})" for i in (1, 2, 3))
    + ") / total, 6) AS share FROM t",
)
def svd_explained(spark, sf_dir):
    """Three directions without centring, and the share of variance along them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"), F.col("embedding").cast("array<double>").alias("x"))
    directions = encode.truncated_svd(rows, "v", 3)
    return encode.explained(encode.projected(rows, "v", directions, "p"), "p", "x").withColumn("share", F.round("share", 6))


@query(
    "fitted_pipeline",
    "SELECT doc_id, n_chars::DOUBLE AS n_chars, lang FROM documents",
)
def fitted_pipeline(spark, sf_dir):
    """A fitted transformer, saved and loaded: each document's last feature and, from its one-hot part, its language."""
    docs = table(spark, sf_dir, "documents").withColumn("n", F.col("n_chars").cast("double"))
    model, folder = encode.column_transformer({}, ["lang"], ["n"]).fit(docs), shared_dir(spark, "transformer")
    encode.save(model, folder)
    labels = F.array(*map(F.lit, [*model.stages[0].labels]))
    x = vector_to_array("features")
    rows = encode.load(folder).transform(docs).select("doc_id", x.alias("x"))
    return rows.select("doc_id", F.element_at("x", -1).alias("n_chars"), F.element_at(labels, F.array_position(F.col("x"), 1.0).cast("int")).alias("lang"))


@query("fitted_tfidf", TFIDF)
def fitted_tfidf(spark, sf_dir):
    """The weights of tfidf_top_terms out of a fitted transformer that was saved and loaded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, folder = encode.fitted_transformer(docs.where("doc_id % 10 < 7"), "doc_id", {"text": 500}, [], []), shared_dir(spark, "transformer")
    encode.save(model, folder)
    terms = F.array(*map(F.lit, model.stages[1].vocabulary))
    rows = encode.load(folder).transform(docs).select("doc_id", F.posexplode(vector_to_array("features")).alias("i", "w")).where("w > 0")
    return rows.select("doc_id", F.get(terms, "i").alias("term"), F.round("w", 6).alias("weight"))


@query("difficulty_bands", METRICS + "SELECT dataset, round(avg(roc_auc), 6) AS mean, round(stddev_samp(roc_auc), 6) AS std, round(1 - avg(roc_auc), 6) AS difficulty, CASE WHEN 1 - avg(roc_auc) > 0.4 THEN 'HARD' WHEN 1 - avg(roc_auc) > 0.25 THEN 'MEDIUM' ELSE 'EASY' END AS band FROM (SELECT model AS dataset, dataset AS model, roc_auc + regexp_extract(model, '[0-9]+')::INTEGER / 50.0::DOUBLE AS roc_auc FROM a) GROUP BY 1")
def difficulty_bands(spark, sf_dir):
    """Difficulty by source, in the bands of the short analysis."""
    swapped = _by_dataset(spark, sf_dir).select(F.col("model").alias("dataset"), F.col("dataset").alias("model"), (F.col("roc_auc") + F.regexp_extract("model", "[0-9]+", 0).cast("int") / 50.0).alias("roc_auc"))
    return compare.difficulty(swapped, 0.4, 0.25).withColumns({c: F.round(c, 6) for c in ("mean", "std", "difficulty")})


@query(
    "adaptive_plateau",
    """
    WITH RECURSIVE h AS (SELECT event_type AS run, (ts::DATE - DATE '2024-01-01')::INTEGER AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY 1, 2),
         a AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM h),
         r AS (SELECT run, i, epoch, loss, loss AS best, TRUE AS improved, 0 AS waited FROM a WHERE i = 1 UNION ALL
               SELECT a.run, a.i, a.epoch, a.loss, CASE WHEN r.best - a.loss > greatest(a.loss * 0.01, 1e-6) THEN a.loss ELSE r.best END, r.best - a.loss > greatest(a.loss * 0.01, 1e-6),
                      CASE WHEN r.best - a.loss > greatest(a.loss * 0.01, 1e-6) THEN 0 ELSE r.waited + 1 END FROM r JOIN a ON a.run = r.run AND a.i = r.i + 1)
    SELECT run, epoch, loss, best, improved, waited, waited >= 5 AS stop FROM r
    """,
)
def adaptive_plateau(spark, sf_dir):
    """Daily mean values of each event type, with improvements against a best that only improvements move."""
    events = table(spark, sf_dir, "events")
    history = events.groupBy(F.col("event_type").alias("run"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return compare.adaptive_plateau(history, "run", "epoch", "loss")


@query("threshold_sweep_middle", SWEEP.replace("min(score) AS a, max(score) AS b", "quantile_cont(score, 0.05) AS a, quantile_cont(score, 0.95) AS b") + "SELECT idx, round(threshold, 6) AS threshold, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM o")
def threshold_sweep_middle(spark, sf_dir):
    """Thresholds between the 5th and the 95th percentile, as for sequence models."""
    out = evaluate.threshold_sweep(_scored(spark, sf_dir), "score", "toxic", low=0.05, high=0.95)
    return out.select("idx", F.round("threshold", 6).alias("threshold"), *(F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")))


@query(
    "capped_sequences",
    """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) - 4 AS total FROM events),
         k AS (SELECT user_id, CASE WHEN total <= 7 THEN unnest(range(0, 7)) ELSE round_even(unnest(range(0, 7)) * total / 7.0, 0)::BIGINT END + 5 AS i, total FROM (SELECT DISTINCT user_id, total FROM p WHERE total > 0)),
         w AS (SELECT DISTINCT user_id, i FROM k WHERE i - 4 <= total)
    SELECT a.user_id, a.event_id, string_agg(b.event_id::VARCHAR, ',' ORDER BY b.i) AS steps, a.event_type FROM w JOIN p a USING (user_id, i) JOIN p b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 4 AND a.i GROUP BY 1, 2, 4
    """,
)
def capped_sequences(spark, sf_dir):
    """Seven sequences of five events for each user, evenly spaced in time."""
    events = table(spark, sf_dir, "events").withColumn("step", F.col("event_id").cast("string"))
    out = split.sequences(events, "user_id", ["ts", "event_id"], "step", "event_type", "event_id", 5, most=7)
    return out.select("user_id", "event_id", F.array_join("features", ",").alias("steps"), "event_type")


@query(
    "tile_split_rare",
    f"""
    WITH p AS (SELECT event_id, CASE WHEN event_id % 331 = 0 THEN 'odd' ELSE event_type END AS label, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events),
         t AS (SELECT *, (i - 1) // greatest(n // 10, 1) AS tile FROM p), c AS (SELECT tile, label, count(*) AS k FROM t GROUP BY 1, 2),
         f AS (SELECT tile, sum(k) AS tn, min(k) AS least, count(*) AS labels FROM c GROUP BY 1), s AS (SELECT t.*, tn, floor(tn * 0.7 + 1e-9) AS ahead, least, labels FROM t JOIN f USING (tile) WHERE tn >= 10),
         r AS (SELECT *, CASE WHEN least < 2 OR ahead < labels OR tn - ahead < labels THEN row_number() OVER (PARTITION BY tile ORDER BY i) <= ahead
                              ELSE row_number() OVER (PARTITION BY tile, label ORDER BY {EVENT_HASH}, event_id) <= floor(count(*) OVER (PARTITION BY tile, label) * 0.7 + 1e-9) END AS tr FROM s)
    SELECT event_id, tile::BIGINT AS tile, CASE WHEN tr THEN 'train' WHEN row_number() OVER (PARTITION BY tr, label, tile ORDER BY {EVENT_HASH2}, event_id) % 2 = 1 THEN 'val' ELSE 'test' END AS split FROM r
    """,
)
def tile_split_rare(spark, sf_dir):
    """Tiles with a label of one row are cut by position."""
    label = F.when(F.col("event_id") % 331 == 0, "odd").otherwise(F.col("event_type"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", label.alias("label"))
    return split.by_tiles(events, ["ts", "event_id"], "event_id", "label").select("event_id", F.col("tile").cast("long").alias("tile"), "split")
