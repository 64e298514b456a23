"""The three classifiers, fitted on prepared vectors."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsekit.models.evaluate import confusion, metrics, positive_score, rank_auc
from lapsekit.operators.columns import union_all


def logistic_regression(label: str = "label") -> LogisticRegression:
    return LogisticRegression(labelCol=label, maxIter=100)


def decision_tree(label: str = "label", seed: int = 5) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol=label, seed=seed)


def random_forest(label: str = "label", seed: int = 12) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, seed=seed)


CLASSIFIERS = {
    "logistic_regression": logistic_regression,
    "decision_tree": decision_tree,
    "random_forest": random_forest,
}


@dataclass(frozen=True)
class Fitted:
    model: Transformer
    train: DataFrame
    test: DataFrame
    seconds: float


def fit_predict(estimator: Estimator, train: DataFrame, test: DataFrame) -> Fitted:
    """Fit on ``train``, time it, and predict both sides."""
    start = time.monotonic()
    model = estimator.fit(train)
    seconds = time.monotonic() - start
    return Fitted(model, model.transform(train), model.transform(test), seconds)


def compare(fits: Mapping[str, Fitted], beta: float = 1.0, label: str = "label") -> DataFrame:
    """A row per model and side with counts, scores, score AUC and the seconds the fit took.

    All predictions are counted in one aggregate and ranked in another, however many models there are.
    """
    sides = [
        pred.select(
            F.lit(name).alias("model"), F.lit(side).alias("split"), "prediction", F.col(label).alias("actual"), positive_score().alias("score")
        )
        for name, fitted in fits.items()
        for side, pred in (("train", fitted.train), ("test", fitted.test))
    ]
    rows, by = union_all(*sides), ["model", "split"]
    counts = metrics(confusion(rows, label="actual", by=by), beta)
    seconds = F.create_map(*[F.lit(x) for name, fitted in fits.items() for x in (name, float(fitted.seconds))])
    ranks = rank_auc(rows, "score", "actual", by)
    return counts.join(ranks, by, "left").withColumn("seconds", seconds[F.col("model")])


def report(name: str, fitted: Fitted, beta: float = 1.0, label: str = "label") -> DataFrame:
    """``compare`` of one model."""
    return compare({name: fitted}, beta, label).orderBy(F.desc("split"))
