"""Grid search over the number of trees by cross-validation."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel
from pyspark.util import inheritable_thread_target

from lapsekit.models.classifiers import random_forest
from lapsekit.models.evaluate import positive_score, rank_auc
from lapsekit.models.prepare import FeaturePlan, vectors_only
from lapsekit.operators.columns import union_all

# The grid.
NUM_TREES = (50, 75, 100, 125)


@dataclass(frozen=True)
class Tuned:
    """The area under the ROC curve of each grid point and fold, and the best model, fitted on all rows."""

    num_trees: tuple[int, ...]
    folds: np.ndarray
    model: PipelineModel
    seconds: float

    @property
    def best(self) -> int:
        """The grid point of the highest mean, the first of equal ones."""
        return self.num_trees[int(self.folds.mean(axis=1).argmax())]


def tune_forest(
    train: DataFrame,
    plan: FeaturePlan,
    num_trees: Sequence[int] = NUM_TREES,
    seed: int = 12,
    fold_col: str = "fold",
    parallelism: int = 4,
    label: str = "label",
    folds: int = 3,
) -> Tuned:
    """Cross-validated forest; ``train`` carries the fold of every row (0 to ``folds`` - 1) in ``fold_col``.

    Preparation is fitted once for each fold, on its training rows alone, so no fold
    sees statistics of its own validation rows; the grid runs on the prepared
    vectors. Folds come from the key and the seed is set, so a repeated run gives
    the same numbers.
    """
    areas = np.zeros((len(num_trees), folds))
    for fold in range(folds):
        sides = [train.where(F.col(fold_col) != fold), train.where(F.col(fold_col) == fold)]
        prepared = Pipeline(stages=plan.stages()).fit(sides[0])
        fit_on, judge_on = (vectors_only(prepared, s, label).persist(StorageLevel.MEMORY_AND_DISK) for s in sides)
        fit_on.count()

        def scored(trees: int, fit_on: DataFrame = fit_on, judge_on: DataFrame = judge_on) -> DataFrame:
            """The validation rows' scores, made once and kept: the ranking reads them in several stages at a time."""
            model = random_forest(label, seed).setNumTrees(trees).fit(fit_on)
            scores = model.transform(judge_on).select(F.lit(trees).alias("trees"), label, positive_score().alias("score"))
            scores = scores.persist(StorageLevel.MEMORY_AND_DISK)
            scores.count()
            return scores

        with ThreadPoolExecutor(parallelism) as pool:
            judged = list(pool.map(inheritable_thread_target(train.sparkSession)(scored), num_trees))
        # the whole grid in one pass
        found = {r.trees: r.auc_score for r in rank_auc(union_all(*judged), "score", label, ["trees"]).collect()}
        areas[:, fold] = [found[trees] for trees in num_trees]
        for kept in (*judged, judge_on, fit_on):
            kept.unpersist()
    best = num_trees[int(areas.mean(axis=1).argmax())]
    start = time.monotonic()
    model = Pipeline(stages=[*plan.stages(), random_forest(label, seed).setNumTrees(best)]).fit(train)
    return Tuned(tuple(num_trees), areas, model, time.monotonic() - start)


def grid_report(tuned: Tuned, spark) -> DataFrame:
    """Mean and deviation of the ROC AUC per grid point."""
    mean, std = tuned.folds.mean(axis=1).tolist(), tuned.folds.std(axis=1).tolist()
    rows = list(zip(tuned.num_trees, mean, std, strict=True))
    return spark.createDataFrame(rows, "num_trees int, mean_auc double, std_auc double")


def best_num_trees(tuned: Tuned) -> int:
    return tuned.best
