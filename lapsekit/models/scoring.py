"""Scores per customer and their join back to the features."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame

from lapsekit.functions import positive_probability


def score(model: Transformer, df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Prediction, label and class probabilities for every row the model accepts."""
    return model.transform(df).select(key, "prediction", label, "probability")


def churn_scores(model: Transformer, df: DataFrame, key: str) -> DataFrame:
    """Probability of churn per customer, as a float column."""
    return model.transform(df).select(key, positive_probability("probability").alias("Proba_churn"))


def with_scores(features: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Features with their score; rows the model skipped keep NULL."""
    return features.join(scores, [key], "left")
