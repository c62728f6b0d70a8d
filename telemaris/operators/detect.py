"""Detectors: principal components, reconstruction error, isolation forest, k-means purity."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from telemaris.operators.ordered import hash_order


def pca(train: DataFrame, features: str, k: int) -> tuple[list[float], list[list[float]], list[float]]:
    """(mean, components, explained shares) of array features. Spark's PCA does not centre when it projects, so we do."""
    rows = train.select(array_to_vector(features).alias("v"))
    mean = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(rows)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(mean.transform(rows))
    return mean.mean.toArray().tolist(), model.pc.toArray().T.tolist(), model.explainedVariance.toArray().tolist()


def _projector(mean: list[float], components: list[list[float]], rebuild: bool):
    """A vectorised function of array features: coordinates along the components, or the mean square of what they do not explain.

    The matrix goes to the workers with the function, so a plan's size does not depend on it.
    """
    centre, axes = np.array(mean, float), np.array(components, float).reshape(len(components), -1)

    @F.pandas_udf("double" if rebuild else "array<double>")
    def project(column: pd.Series) -> pd.Series:
        some = np.flatnonzero(column.notna())
        out = np.full(len(column), None, object)
        if len(some):
            x = np.stack(column.iloc[some].to_numpy()).astype(float) - centre
            p = x @ axes.T
            for i, value in zip(some, ((x - p @ axes) ** 2).mean(axis=1) if rebuild else p, strict=True):
                out[i] = value
        return pd.Series(out, dtype=float if rebuild else object)

    return project


def pca_projection(df: DataFrame, features: str, mean: list[float], components: list[list[float]]) -> DataFrame:
    """df with `projection`: centred coordinates along the components; null without features."""
    return df.withColumn("projection", _projector(mean, components, False)(F.col(features).cast("array<double>")))


def reconstruction_error(df: DataFrame, features: str, mean: list[float], components: list[list[float]]) -> DataFrame:
    """df with `error`: mean square of what the components, which are orthonormal, do not explain; null without features."""
    return df.withColumn("error", _projector(mean, components, True)(F.col(features).cast("array<double>")))


def sequence_error(df: DataFrame, sequence: str, mean: list[float], components: list[list[float]]) -> DataFrame:
    """df with `error`: the mean of reconstruction_error over a sequence's steps (arrays of features), whose weights are equal."""
    rows = reconstruction_error(df.withColumn("__flat", F.flatten(sequence)), "__flat", mean, components)
    return rows.drop("__flat")


def most_frequent(df: DataFrame, label: str, k: int = 10, above: int = 20) -> DataFrame:
    """Rows of the k most frequent labels (ties by name) if there are more than `above`, else all."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    many = counts.limit(above + 1).count() > above
    return df.join(counts.orderBy(F.desc("n"), label).limit(k).select(label), label, "left_semi") if many else df


def kmeans_purity(df: DataFrame, features: str, label: str, k: int = 2, seed: int = 42) -> DataFrame:
    """(cluster, n, purity) of k-means clusters."""
    rows = df.select(label, array_to_vector(features).alias("v"))
    found = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(rows).transform(rows)
    per = found.groupBy("cluster", label).agg(F.count("*").alias("n"))
    return per.groupBy("cluster").agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("purity"))


def silhouette(df: DataFrame, features: str, label: str) -> float:
    """Squared-Euclidean silhouette of the labels; 0 for ten rows or fewer, or for one class."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = df.select(F.col(label).cast("double").alias("prediction"), array_to_vector(features).alias("features"))
    if rows.limit(11).count() <= 10 or rows.select("prediction").distinct().limit(2).count() < 2:
        return 0.0
    return ClusteringEvaluator().evaluate(rows)


def sampled_silhouette(df: DataFrame, key: str, features: str, label: str, most: int = 1000, seed: int = 42) -> DataFrame:
    """(key, label, own, other, silhouette) of a sample of `most` rows, each against all rows; Euclidean distances, exact.

    own: mean distance to the other rows of its label; other: the least mean distance to a label's rows; the silhouette is
    (other - own) / max(own, other), and 0 for the only row of a label, for one label in all, and where there are ten rows or
    fewer. The sample, first by hash, goes to every task; a task keeps one sum per sample row and label, no pairs, so its memory is
    bounded by most * labels. Rows without features or label take no part; with `most` rows or fewer it is the whole silhouette.
    """
    rows = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(key, features, F.col(label).cast("string").alias("label"))
    picked = rows.orderBy(hash_order(key, seed), key).limit(most).collect()  # bounded
    few = rows.limit(11).count() <= 10
    points = np.array([r[features] for r in picked], float) if picked else np.zeros((0, 0))
    middle = points.mean(axis=0) if len(points) else 0.0
    points, squares = points - middle, ((points - middle) ** 2).sum(axis=1)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows or not len(points):
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - middle
            labels = np.array(batch.column(1).to_pylist(), object)
            for a in range(0, len(x), 2048):
                part, mine = x[a : a + 2048], labels[a : a + 2048]
                d = np.sqrt(np.maximum((part**2).sum(axis=1)[:, None] - 2 * part @ points.T + squares, 0))
                for name in set(mine):
                    sums[name] = sums.get(name, 0) + d[mine == name].sum(axis=0)
                    sizes[name] = sizes.get(name, 0) + int((mine == name).sum())
        for name, total in sums.items():
            n = len(total)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(n), pa.int32()), "to": pa.array([name] * n), "d": pa.array(total), "n": pa.array([sizes[name]] * n, pa.int64())})

    per = rows.select(F.col(features).cast("array<double>"), "label").mapInArrow(distances, "i int, to string, d double, n long").groupBy("i", "to").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    sample = df.sparkSession.createDataFrame([(i, r[key], r["label"]) for i, r in enumerate(picked)], T.StructType([T.StructField("i", T.IntegerType()), df.schema[key], T.StructField("label", T.StringType())]))
    same = F.col("to") == F.col("label")
    ends = per.join(F.broadcast(sample), "i").groupBy("i", key, "label").agg(F.max(F.when(same & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("own"), F.min(F.when(~same, F.col("d") / F.col("n"))).alias("other"))
    worth = F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other"))
    return ends.select(key, "label", "own", "other", (F.lit(0.0) if few else F.coalesce(worth, F.lit(0.0))).alias("silhouette"))


def moved_centres(df: DataFrame, features: str, centres: np.ndarray) -> np.ndarray:
    """One round of k-means: the mean of each centre's nearest rows (ties to the first); a centre without rows stays."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                at = nearest_centre(x, centres)
                np.add.at(total, at, x)
                n += np.bincount(at, minlength=len(centres))
        yield pa.RecordBatch.from_pydict({"c": pa.array(range(len(n)), pa.int32()), "total": pa.array(total.tolist(), pa.list_(pa.float64())), "n": pa.array(n)})

    parts = df.select(F.col(features).cast("array<double>")).mapInArrow(add, "c int, total array<double>, n long")
    sums = parts.select("c", "n", F.posexplode("total").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).where("n > 0")
    out = centres.copy()
    for r in sums.collect():  # centres x components rows
        out[r["c"], r["i"]] = r["x"] / r["n"]
    return out


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - m) ** 2).sum(axis=1) for m in centres]).argmin(axis=0)


def lloyd(df: DataFrame, key: str, features: str, k: int = 2, rounds: int = 10, seed: int = 42) -> DataFrame:
    """df with `cluster`: k-means from the k rows first by a hash of the key, the same in each run."""
    start = df.where(F.col(features).isNotNull()).orderBy(hash_order(key, seed), key).select(F.col(features).cast("array<double>")).limit(k).collect()
    centres = np.array([r[0] for r in start], float)
    for _ in range(rounds if len(start) else 0):
        centres = moved_centres(df.where(F.col(features).isNotNull()), features, centres)

    @F.pandas_udf("int")
    def cluster(column: pd.Series) -> pd.Series:
        some = column.notna()
        out = pd.Series([None] * len(column), index=column.index, dtype="Int32")
        if some.any():
            out[some] = nearest_centre(np.stack(column[some].to_numpy()).astype(float), centres)
        return out

    return df.withColumn("cluster", cluster(F.col(features).cast("array<double>")))


def purity(clustered: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, n, purity): the share of each cluster's most frequent label."""
    per = clustered.groupBy(cluster, label).agg(F.count("*").alias("n"))
    return per.groupBy(cluster).agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("purity"))


# Isolation forest (Liu et al. 2008): trees are built in parallel from small samples, then all rows are scored by batches


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """Nodes [feature, cut, left, right, path length of a leaf]; a leaf has feature -1."""
    nodes: list[list[float]] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        part = x[rows]
        open_ = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 and depth < limit else []
        if not len(open_):
            nodes.append([-1, 0.0, 0, 0, depth + _average_path(len(rows))])
            continue
        f = int(rng.choice(open_))
        cut = rng.uniform(part[:, f].min(), part[:, f].max())
        nodes.append([f, float(cut), 0, 0, 0.0])
        low = part[:, f] <= cut
        todo += [(rows[low], depth + 1, len(nodes) - 1, 0), (rows[~low], depth + 1, len(nodes) - 1, 1)]
    return nodes


def isolation_forest(train: DataFrame, key: str, features: str, trees: int = 100, rows: int = 256, seed: int = 42) -> list[list[list[float]]]:
    """The trees. A tree's sample are the rows first by a hash of key and tree; each task keeps `rows` per tree before the shuffle."""
    n = train.count()
    likely = min(1.0, (2 * rows + 64) / max(n, 1))  # enough rows for each tree, without a copy of the table per tree
    draw = lambda tree: F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(2**32))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: draw(tree) <= int(likely * 2**32))
    spread = train.select(key, features, F.explode(drawn).alias("tree")).withColumn("h", draw(F.col("tree")))
    limit = int(np.ceil(np.log2(max(rows, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        picked = pdf.sort_values(["h", key]).head(rows)
        return pd.DataFrame({"tree": [tree], "nodes": [json.dumps(_grow(np.stack(picked[features].to_numpy()).astype(float), np.random.default_rng([seed, tree]), limit))]})

    found = spread.groupBy("tree").applyInPandas(build, "tree int, nodes string").orderBy("tree").collect()  # trees of 2 * rows nodes at most
    return [json.loads(r["nodes"]) for r in found]


def isolation_scores(df: DataFrame, features: str, forest: list[list[list[float]]], rows: int = 256) -> DataFrame:
    """df with `score` = 2 ** (-mean path / c(rows)) - 0.5; higher is more anomalous."""
    trees = df.sparkSession.sparkContext.broadcast([np.array(t) for t in forest])

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=float)
        x = np.stack(column.to_numpy()).astype(float)
        total = np.zeros(len(x))
        for tree in trees.value:
            at = np.zeros(len(x), int)
            while (inner := tree[at, 0] >= 0).any():
                here = at[inner]
                right = x[inner, tree[here, 0].astype(int)] > tree[here, 1]
                at[inner] = np.where(right, tree[here, 3], tree[here, 2]).astype(int)
            total += tree[at, 4]
        return pd.Series(2 ** (-total / len(trees.value) / _average_path(rows)) - 0.5)

    return df.withColumn("score", score(features))


def projected_sample(df: DataFrame, key: str, features: str, n: int, k: int = 2, seed: int = 42) -> DataFrame:
    """(key, projection): a sample of n rows along its first k components; the key travels with the row."""
    picked = df.orderBy(hash_order(key, seed), key).limit(n)
    mean, components, _ = pca(picked, features, k)
    return pca_projection(picked, features, mean, components).select(key, "projection")
