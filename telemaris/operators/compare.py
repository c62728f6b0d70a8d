"""Comparison of detectors over data sets, from a table of metrics (model, dataset, version, roc_auc, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from telemaris.operators.ordered import quantiles_by

# How costly a kind of model is.
COMPLEXITY = {"SAE": 1.0, "IFOREST": 0.5, "LSTM-SAE": 3.0, "GRU-SAE": 2.5}


def ranking(metrics: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """metrics with `place` per data set, 1 the best; ties by model."""
    return metrics.withColumn("place", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc(metric), "model")))


def model_matrix(metrics: DataFrame, models: list[str], metric: str = "roc_auc") -> DataFrame:
    return metrics.groupBy("dataset").pivot("model", models).agg(F.avg(metric))


def long_form(metrics: DataFrame, names: list[str]) -> DataFrame:
    return metrics.unpivot(["model", "dataset"], names, "metric", "value")


def box_summary(long: DataFrame) -> DataFrame:
    """(metric, low, p25, p50, p75, high), exact, however many values a metric has."""
    ends = long.groupBy(F.col("metric").alias("__m")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    middle = quantiles_by(long, "metric", "value", [0.25, 0.5, 0.75])
    return middle.join(ends, F.col("metric").eqNullSafe(F.col("__m"))).select("metric", "low", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "high")


def difficulty(metrics: DataFrame, hard: float = 0.3, medium: float = 0.2, metric: str = "roc_auc") -> DataFrame:
    """(dataset, mean, std, difficulty, band): difficulty = 1 - mean; std is the sample's."""
    rows = metrics.groupBy("dataset").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std")).withColumn("difficulty", 1 - F.col("mean"))
    return rows.withColumn("band", F.when(F.col("difficulty") > hard, "HARD").when(F.col("difficulty") > medium, "MEDIUM").otherwise("EASY"))


def agreement(metrics: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """(dataset, agreement, span): 1 - population deviation over models, and the range."""
    return metrics.groupBy("dataset").agg((1 - F.stddev_pop(metric)).alias("agreement"), (F.max(metric) - F.min(metric)).alias("span"))


def version_change(metrics: DataFrame, before: str = "v1", after: str = "v2", metric: str = "roc_auc") -> DataFrame:
    """(model, drop, risk, increase_risk): what a model loses from one version to the next, and what that tells."""
    a, b = (metrics.where(F.col("version") == v).groupBy("model").agg(F.avg(metric).alias(v)) for v in (before, after))
    drop = F.col(before) - F.col(after)
    both = a.join(b, "model").withColumn("drop", drop)
    risk = F.when(F.col("drop") > 0.05, "HIGH").when(F.col("drop") > 0.02, "MEDIUM").otherwise("LOW")
    harder = F.when(F.col("drop") > 0.1, "LOW").when(F.col("drop") > 0, "MEDIUM").otherwise("HIGH")
    return both.select("model", "drop", risk.alias("risk"), harder.alias("increase_risk"))


def stability(metrics: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """(model, mean, std, consistency, relative, transferability): sample deviation; a single data set has none (0)."""
    rows = metrics.groupBy("model").agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"))
    cv = F.try_divide(F.col("std"), F.col("mean"))
    return rows.select("model", "mean", "std", (1 / (1 + F.col("std"))).alias("consistency"), (1 - cv).alias("relative"), (1 / (1 + cv)).alias("transferability"))


def efficiency(metrics: DataFrame, weights: dict[str, float] = COMPLEXITY, metric: str = "roc_auc") -> DataFrame:
    """(model, efficiency): mean metric over the model's weight, 1 if it has none."""
    pairs = [F.lit(x) for k, v in weights.items() for x in (k, v)]
    return metrics.groupBy("model").agg(F.avg(metric).alias("mean")).select("model", (F.col("mean") / F.coalesce(F.create_map(*pairs)[F.col("model")], F.lit(1.0))).alias("efficiency"))


def extremes(metrics: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """(best, worst, steadiest) models by mean, mean and least deviation; ties by name."""
    rows = stability(metrics, metric)
    return rows.agg(F.min_by("model", F.struct(-F.col("mean"), "model")).alias("best"), F.min_by("model", F.struct("mean", "model")).alias("worst"), F.min_by("model", F.struct("std", "model")).alias("steadiest"))


def statistics(metrics: DataFrame, key: str, metric: str = "roc_auc") -> DataFrame:
    return metrics.groupBy(key).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("low"), F.max(metric).alias("high"), F.count(metric).alias("n"))


def plateau(history: DataFrame, run: str, epoch: str, loss: str, baseline: int = 5, absolute: float = 0.0005, relative: float = 0.005, patience: int = 5, window: int = 10, least: float = 0.02) -> DataFrame:
    """history with `candidate`, `significant`, `waited` and `stop` for each row of a run.

    candidate: not among the first `baseline` rows, and lower than the row before by both thresholds. significant: a
    candidate below every earlier one. waited: rows since the last significant one (or the baseline's end). stop: waited
    for `patience` rows, or improved less than `least` over the last `window` rows.
    """
    w = W.partitionBy(run).orderBy(epoch)
    rows = history.withColumn("__i", F.row_number().over(w)).withColumn("__p", F.lag(loss).over(w))
    drop = F.col("__p") - F.col(loss)
    candidate = F.coalesce((F.col("__i") > baseline) & (drop >= absolute) & (drop / F.col("__p") >= relative), F.lit(False))
    rows = rows.withColumn("candidate", candidate)
    before = F.min(F.when(F.col("candidate"), F.col(loss))).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("significant", F.col("candidate") & (before.isNull() | (F.col(loss) < before)))
    last = F.max(F.when(F.col("significant"), F.col("__i"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("waited", F.greatest(F.col("__i") - F.coalesce(last, F.lit(baseline)), F.lit(0)))
    start = F.first(loss).over(w.rowsBetween(-(window - 1), 0))
    stale = (F.col("__i") >= window) & ((start - F.col(loss)) / start < least)
    return rows.withColumn("stop", (F.col("__i") > baseline) & ((F.col("waited") >= patience) | stale)).drop("__i", "__p")


def adaptive_plateau(history: DataFrame, run: str, epoch: str, loss: str, ratio: float = 0.01, floor: float = 1e-6, patience: int = 5) -> DataFrame:
    """history with `best`, `improved`, `waited` and `stop` for each row of a run.

    improved: the best loss so far exceeds this one by more than max(loss * ratio, floor); only then it becomes the best. So many
    small steps down may add up to an improvement, and whether a row is one depends on the rows that were: a fold, not a window.
    A loss that is not below all earlier ones never improves, so the fold sees the record lows of a run alone.
    waited: rows since the last improvement. stop: waited for `patience` rows. A row without a loss (null) neither improves nor
    waits; NaN waits.
    """
    w = W.partitionBy(run).orderBy(epoch)
    number = F.when(~F.isnan(loss), F.col(loss))
    low = F.min(number).over(w.rowsBetween(W.unboundedPreceding, -1))
    records = history.withColumn("__low", low).where(number.isNotNull() & (F.col("__low").isNull() | (F.col(loss) < F.col("__low"))))
    lows = records.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("epoch"), F.col(loss).cast("double").alias("loss")))).alias("lows"))
    none = F.slice("lows", 1, 0)
    better = lambda kept, x: (F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["loss"] - x["loss"] > F.greatest(x["loss"] * ratio, F.lit(floor)))
    kept = F.aggregate("lows", none, lambda kept, x: F.when(better(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    marks = lows.select(run, F.explode(kept).alias("x")).select(run, F.col("x.epoch").alias(epoch), F.lit(True).alias("improved"))
    rows = history.join(marks, [run, epoch], "left").withColumn("improved", F.coalesce("improved", F.lit(False)))
    rows = rows.withColumn("__i", F.count(loss).over(w.rowsBetween(W.unboundedPreceding, 0)))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("best", F.last(F.when(F.col("improved"), F.col(loss)), ignorenulls=True).over(upto))
    rows = rows.withColumn("waited", (F.col("__i") - F.coalesce(F.max(F.when(F.col("improved"), F.col("__i"))).over(upto), F.lit(0))).cast("int"))
    return rows.withColumn("stop", F.col("waited") >= patience).drop("__i").select(*history.columns, "best", "improved", "waited", "stop")
