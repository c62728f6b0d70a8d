"""Exact evaluation of scores: curves, areas, thresholds, two-sample tests, separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from telemaris.operators.ordered import exact_quantiles, quantiles_by, running


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg): equal scores in one row."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def cumulative(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg, tp, fp, p, n) for each score from the highest down; tp and fp include the score itself."""
    groups = by_score(df, score, label)
    totals = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return running(groups, [F.desc("score")], {"tp": "pos", "fp": "neg"}).join(F.broadcast(totals))


def areas(df: DataFrame, score: str, label: str) -> DataFrame:
    """(roc_auc, average_precision): the rank formula with ties at a half, and the sum of precision over recall steps. Null if a class is missing."""
    c = cumulative(df, score, label)
    roc = F.try_divide(F.try_divide(F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") * 0.5)), F.max("p")), F.max("n"))
    precision = F.try_divide(F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))), F.max("p"))
    return c.agg(roc.alias("roc_auc"), precision.alias("average_precision"))


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, fpr, tpr, precision): a point for each different score."""
    return cumulative(df, score, label).select("score", F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def threshold_sweep(df: DataFrame, score: str, label: str, points: int = 100, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(idx, threshold, precision, recall, f1) at evenly spaced thresholds between two quantiles; predicted is score > threshold.

    Each score counts for the thresholds below it: scores are put into `points` buckets and summed from the top, so nothing
    is joined with all thresholds.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("long").alias("y"))
    if (low, high) == (0.0, 1.0):
        ends = rows.agg(F.min("s").alias("a"), F.max("s").alias("b"))
    else:
        ends = exact_quantiles(rows, {"s": "s"}, [low, high]).select(F.col("q0").alias("a"), F.col("q1").alias("b"))
    at = lambda i: F.col("a") + i * (F.col("b") - F.col("a")) / (points - 1)
    guess = F.greatest(F.lit(0), F.least(F.lit(points), F.ceil((F.col("s") - F.col("a")) / F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / (points - 1)).otherwise(1.0)).cast("int")))
    below = F.when(F.col("s") <= at(guess - 1), guess - 1).when((F.col("s") > at(guess)) & (guess < points), guess + 1).otherwise(guess)  # how many thresholds lie below
    buckets = rows.join(F.broadcast(ends)).groupBy(below.alias("over")).agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("idx")).join(F.broadcast(ends))
    counts = grid.join(F.broadcast(buckets), F.col("over") > F.col("idx"), "left").groupBy("idx", at(F.col("idx")).alias("threshold")).agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("predicted"))
    total = buckets.agg(F.sum("pos").alias("p"))
    out = counts.join(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumn("precision", zero(F.try_divide("tp", "predicted"))).withColumn("recall", zero(F.try_divide("tp", "p")))
    return out.select("idx", "threshold", "precision", "recall", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).alias("f1"))


def best_f1(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc(F.round("f1", 12)), "idx").limit(1)


def class_stats(df: DataFrame, score: str, label: str) -> DataFrame:
    """(label, n, mean, std, median) and the ratio of the classes' means on each row."""
    middle = quantiles_by(df.select(label, score), label, score, [0.5]).select(F.col(label).alias("__label"), F.col("q0").alias("median"))
    rows = df.groupBy(label).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    rows = rows.join(middle, F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")
    both = W.partitionBy()
    return rows.withColumn("ratio", F.try_divide(F.max(F.when(F.col(label) == 1, F.col("mean"))).over(both), F.max(F.when(F.col(label) == 0, F.col("mean"))).over(both)))


def ks_test(df: DataFrame, score: str, label: str) -> DataFrame:
    """(d, p): the largest gap of the classes' distributions, and its asymptotic two-sided p."""
    c = cumulative(df, score, label)
    d = c.agg(F.max(F.abs(F.try_divide("tp", "p") - F.try_divide("fp", "n"))).alias("d"), F.max("p").alias("p"), F.max("n").alias("n"))
    x = F.pow(F.col("d"), 2) * F.col("p") * F.col("n") / (F.col("p") + F.col("n"))
    tail = sum((((-1) ** (k - 1)) * F.exp(-2.0 * k * k * x) for k in range(2, 101)), F.exp(-2.0 * x))
    return d.select("d", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * tail)).alias("p"))


def two_sided(z: Column) -> Column:
    """The two-sided p of a normal deviate: 1 - erf(z / sqrt 2), by the series with positive terms; 0 above 8."""
    x2 = z * z / 2
    term = z / F.sqrt(F.lit(2.0))
    start = F.struct(term.alias("t"), term.alias("s"))
    step = lambda a, n: F.struct((a["t"] * 2 * x2 / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * x2 / (2 * n + 1)).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step, lambda a: a["s"])
    erf = 2 / F.sqrt(F.lit(3.141592653589793)) * F.exp(-x2) * total
    return F.when(z > 8, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - erf)))


def mann_whitney(df: DataFrame, score: str, label: str) -> DataFrame:
    """(u, z, p): U of class 1, its normal approximation with tie and continuity correction, and the two-sided p."""
    c = cumulative(df, score, label)
    ties = F.col("pos") + F.col("neg")
    row = c.agg(
        F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") * 0.5)).alias("u"), F.max("p").cast("double").alias("p"), F.max("n").cast("double").alias("n"),
        F.sum((ties * ties * ties - ties).cast("double")).alias("t"),
    )
    total = F.col("p") + F.col("n")
    spread = F.sqrt(F.col("p") * F.col("n") / 12 * (total + 1 - F.col("t") / (total * (total - 1))))
    off = F.abs(F.col("u") - F.col("p") * F.col("n") / 2)
    return row.select("u", F.try_divide(F.greatest(off - 0.5, F.lit(0.0)), spread).alias("z")).withColumn("p", two_sided(F.col("z")))


def histogram_overlap(df: DataFrame, score: str, label: str, edges: int = 50) -> DataFrame:
    """(overlap): the common area of both classes' densities over edges - 1 equal bins; 0 if all of class 1 lies above class 0."""
    bins = edges - 1
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))
    ends = rows.agg(F.min("s").alias("a"), F.max("s").alias("b"), F.max(F.when(F.col("y") == 0, F.col("s"))).alias("top0"), F.min(F.when(F.col("y") == 1, F.col("s"))).alias("low1"), F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    at = F.least(F.floor((F.col("s") - F.col("a")) / F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / bins).otherwise(1.0)), F.lit(bins - 1))
    counts = rows.join(F.broadcast(ends.select("a", "b"))).groupBy(at.alias("bin")).agg(F.sum(1 - F.col("y")).alias("c0"), F.sum("y").alias("c1"))
    area = counts.join(F.broadcast(ends.select("n0", "n1"))).agg(F.sum(F.least(F.try_divide("c0", "n0"), F.try_divide("c1", "n1"))).alias("area"))
    return area.join(F.broadcast(ends.select("top0", "low1"))).select(F.when(F.col("top0") < F.col("low1"), 0.0).otherwise(F.col("area")).alias("overlap"))


def effect_size(df: DataFrame, score: str, label: str) -> DataFrame:
    """(cohens_d): class 1 minus class 0, over the pooled deviation of population variances."""
    one, zero = (F.when(F.col(label) == y, F.col(score)) for y in (1, 0))
    row = df.agg(F.count(one).alias("n1"), F.count(zero).alias("n0"), F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.var_pop(one).alias("v1"), F.var_pop(zero).alias("v0"))
    pooled = F.sqrt(F.try_divide((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), F.col("n0") + F.col("n1") - 2))
    return row.select(F.try_divide(F.col("m1") - F.col("m0"), pooled).alias("cohens_d"))


def class_separation(df: DataFrame, features: str, label: str) -> DataFrame:
    """(centroid_distance, intra_distance, separation) of two classes 0 and 1 with array features."""
    long = df.select(label, F.posexplode(features).alias("i", "x"))
    centres = long.groupBy(label, "i").agg(F.avg("x").alias("c"))
    centres = centres.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centre"))
    away = F.sqrt(F.aggregate(F.zip_with(features, "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    intra = df.join(F.broadcast(centres), label).groupBy(label).agg(F.avg(away).alias("d")).agg(F.avg("d").alias("intra_distance"))
    a, b = (centres.where(F.col(label) == y).select(F.col("centre").alias(f"c{y}")) for y in (0, 1))
    gap = F.sqrt(F.aggregate(F.zip_with("c0", "c1", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    row = a.join(F.broadcast(b)).select(gap.alias("centroid_distance")).join(F.broadcast(intra))
    return row.select("centroid_distance", "intra_distance", (F.col("centroid_distance") / (F.col("intra_distance") + 1e-8)).alias("separation"))


def quality_score(overlap: DataFrame, separability: DataFrame) -> DataFrame:
    """(score, difficulty): the mean of overlap and 1 - separability, one row each; bands at .7, .5 and .3."""
    score = (F.col("overlap") + (1 - F.col(separability.columns[0]))) / 2
    return overlap.join(F.broadcast(separability)).select(score.alias("score")).withColumn("difficulty", F.when(F.col("score") > 0.7, "very hard").when(F.col("score") > 0.5, "hard").when(F.col("score") > 0.3, "moderate").otherwise("easy"))


def percentiles(df: DataFrame, score: str, at: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """(percentile, value), exact."""
    row = exact_quantiles(df, {"s": score}, list(at))
    return row.select(F.explode(F.array(*(F.struct(F.lit(q).alias("percentile"), F.col(f"q{i}").alias("value")) for i, q in enumerate(at)))).alias("x")).select("x.*")


def step_means(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """(key, step, mean): the mean feature value of each step of a sequence of feature arrays."""
    steps = df.select(key, F.posexplode(sequence).alias("step", "f"))
    return steps.select(key, "step", (F.aggregate("f", F.lit(0.0), lambda s, v: s + v) / F.size("f")).alias("mean"))
