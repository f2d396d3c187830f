"""Classifiers on vectors, with the ML library."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_vectors(df: DataFrame, vector: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vector).cast("array<double>")))


def hash_features(df: DataFrame, text: str, out: str = "features", size: int = 1 << 12):
    """Fitted text to vector pipeline: words, hashed counts, inverse document frequency."""
    stages = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
              HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size), IDF(inputCol="_tf", outputCol=out)]
    return Pipeline(stages=stages).fit(df)


def train_binary(df: DataFrame, label: str, features: str = "features", max_iter: int = 20, reg: float = 0.01):
    return LogisticRegression(labelCol=label, featuresCol=features, maxIter=max_iter, regParam=reg).fit(df)


def train_multiclass(df: DataFrame, label: str, layers: Sequence[int], features: str = "features",
                     max_iter: int = 30, seed: int = 42):
    return MultilayerPerceptronClassifier(labelCol=label, featuresCol=features, layers=list(layers),
                                          maxIter=max_iter, seed=seed).fit(df)


def predicted(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predicted class and its probability."""
    p = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return p.select(*keep, F.col("prediction").cast("int").alias("prediction"), F.array_max("_p").alias("confidence"))


def draw_grid(grid: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """n_iter random settings out of {param: values}; all of them when there are fewer."""
    rng = random.Random(seed)
    settings, seen = [], set()
    total = 1
    for values in grid.values():
        total *= len(values)
    while len(settings) < min(n_iter, total):
        pick = {p: rng.choice(v) for p, v in grid.items()}
        key = tuple(sorted((p.name, str(v)) for p, v in pick.items()))
        if key not in seen:
            seen.add(key)
            settings.append(pick)
    return settings


def search(estimator, df: DataFrame, grid: dict, n_iter: int, label: str, folds: int = 5, parallelism: int = 4, seed: int = 42):
    """Best of a random draw from a grid by cross-validated F1."""
    metric = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=draw_grid(grid, n_iter, seed), evaluator=metric,
                        numFolds=folds, parallelism=parallelism, seed=seed)
    return cv.fit(df)
