"""Training and applying the record filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def norms(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Euclidean norms of the training columns, kept with the model and used again when scoring."""
    row = df.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in features]).first()
    return {c: float(row[c] or 0.0) for c in features}


def normalized(df: DataFrame, scale: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / max(s, 1e-12) for c, s in scale.items()})


def train(df: DataFrame, features: list[str], label: str = "label", hidden: tuple[int, ...] = (64, 64, 64), rounds: int = 100, seed: int = 37) -> tuple[MultilayerPerceptronClassificationModel, dict[str, float]]:
    """A perceptron of three hidden layers over normalised columns, trained by Spark."""
    scale = norms(df, features)
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(normalized(df, scale))
    return MultilayerPerceptronClassifier(layers=[len(features), *hidden, 2], featuresCol="_x", labelCol=label, maxIter=rounds, seed=seed).fit(rows), scale


def scored(df: DataFrame, model: MultilayerPerceptronClassificationModel, scale: dict[str, float]) -> DataFrame:
    """Rows with ``score``, the probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    features = list(scale)
    keep = df.columns
    rows = VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_x").transform(df.withColumns({f"_{c}": F.col(c) / max(s, 1e-12) for c, s in scale.items()}))
    return model.transform(rows.select(*keep, F.col("_x").alias(model.getFeaturesCol()))).select(*keep, vector_to_array("probability")[1].alias("score"))


def scored_by_layers(df: DataFrame, features: list[str], layers: list[dict], scale: dict[str, float]) -> DataFrame:
    """Rows with ``score`` from given layers (weight, bias, and running mean, variance, gamma, beta of a batch norm), mish between them and a sigmoid last."""

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack([pdf[c].to_numpy(np.float64) / max(scale[c], 1e-12) for c in features], 1)
            for k, layer in enumerate(layers):
                x = x @ np.asarray(layer["weight"]).T + np.asarray(layer["bias"])
                if k + 1 < len(layers):
                    if "mean" in layer:
                        x = (x - np.asarray(layer["mean"])) / np.sqrt(np.asarray(layer["variance"]) + 1e-5) * np.asarray(layer["gamma"]) + np.asarray(layer["beta"])
                    x = x * np.tanh(np.logaddexp(0, x))
            yield pdf.assign(score=1 / (1 + np.exp(-x[:, 0])))

    return df.mapInPandas(forward, df.schema.add("score", DoubleType()))
