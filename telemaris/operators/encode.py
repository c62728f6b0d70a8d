"""Feature encoding fitted on training rows alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, Normalizer, OneHotEncoder, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

WORDS = r"(?U)\b\w\w+\b"


def standard(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) of each column."""
    row = train.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def standardised(df: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns minus mean over deviation; a constant column becomes 0."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0) for c, (m, s) in fit.items()})


def tokens(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, term, tf): lower-cased words of two letters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))
    return df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(train: DataFrame, most: int) -> DataFrame:
    """(term, df, idf): the terms with the highest total frequency, ties by term. idf = ln((1 + n) / (1 + df)) + 1."""
    n = train.agg(F.count_distinct(train.columns[0]).alias("n_docs"))
    counts = train.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(most)
    return counts.join(F.broadcast(n)).select("term", "total", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): tf * idf, each row's weights to length 1. The vocabulary is capped, so it is broadcast."""
    weight = counts.join(F.broadcast(vocab.select("term", "idf")), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weight.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weight.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def column_transformer(text: dict[str, int], categories: list[str], numbers: list[str]) -> Pipeline:
    """Text columns (column -> vocabulary size) as term counts, categories one-hot (unknown: all zeros), numbers as they are."""
    stages, outputs = [], []
    for c, size in text.items():
        stages += [RegexTokenizer(inputCol=c, outputCol=f"{c}__w", pattern=WORDS, gaps=False, toLowercase=True), CountVectorizer(inputCol=f"{c}__w", outputCol=f"{c}__v", vocabSize=size)]
        outputs.append(f"{c}__v")
    for c in categories:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__o", handleInvalid="error", dropLast=True)]
        outputs.append(f"{c}__o")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*outputs, *numbers], outputCol="features", handleInvalid="keep")])


def fitted_transformer(train: DataFrame, key: str, text: dict[str, int], categories: list[str], numbers: list[str]) -> PipelineModel:
    """column_transformer() with TF-IDF for texts, fitted: counts of the most frequent terms, times ln((1 + n) / (1 + df)) + 1, to length 1.

    Vocabulary and weights come from vocabulary(), so ties go by term; both are in the saved stages, and no stage needs Python.
    key: one value for each row.
    """
    stages, outputs = [], []
    for c, size in text.items():
        terms = vocabulary(tokens(train, c, key), size).collect()  # capped
        stages += [
            RegexTokenizer(inputCol=c, outputCol=f"{c}__w", pattern=WORDS, gaps=False, toLowercase=True),
            CountVectorizerModel.from_vocabulary([r["term"] for r in terms], inputCol=f"{c}__w", outputCol=f"{c}__n"),
            ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in terms]), inputCol=f"{c}__n", outputCol=f"{c}__x"),
            Normalizer(p=2.0, inputCol=f"{c}__x", outputCol=f"{c}__v"),
        ]
        outputs.append(f"{c}__v")
    rest = column_transformer({}, categories, numbers).getStages()[:-1]
    coded = Pipeline(stages=rest).fit(train).stages if rest else []
    outputs += [f"{c}__o" for c in categories]
    return PipelineModel([*stages, *coded, VectorAssembler(inputCols=[*outputs, *numbers], outputCol="features", handleInvalid="keep")])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def truncated_svd(df: DataFrame, features: str, k: int) -> DenseMatrix:
    """The k leading directions of the feature space, without centring. Rows stay sparse; directions alone reach the driver."""
    v = RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(features), features)).computeSVD(k).V
    return DenseMatrix(v.numRows, v.numCols, v.toArray().flatten("F"))


def explained(df: DataFrame, projection: str, features: str) -> DataFrame:
    """(share): the variance along the projection's directions over that of all features (both population variances, summed)."""
    def spread(column: str) -> DataFrame:
        return df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).agg(F.sum("v").alias(column))

    return spread(projection).join(F.broadcast(spread(features))).select(F.try_divide(projection, features).alias("share"))


def projected(df: DataFrame, features: str, directions: DenseMatrix, out: str) -> DataFrame:
    """df with the features' coordinates along the directions, as an array column. The matrix travels with the function, not in the plan."""
    axes = directions.toArray()

    @F.pandas_udf("array<double>")
    def project(column: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(column.to_numpy()).astype(float) @ axes)) if len(column) else pd.Series([], dtype=object)

    return df.withColumn(out, project(vector_to_array(features)))
