"""From a feature table to selected features, compared models and churn scores."""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lapsekit.functions.naming import quote
from lapsekit.models.classifiers import CLASSIFIERS, Fitted, compare, fit_predict, report
from lapsekit.models.prepare import FeaturePlan, vectors_only
from lapsekit.models.scoring import churn_scores, score, with_scores
from lapsekit.models.split import train_test, with_folds
from lapsekit.models.tuning import Tuned, tune_forest
from lapsekit.operators.columns import numeric_columns, text_columns
from lapsekit.operators.statistics import correlation, correlation_pairs, eliminate_backward, moments, prune_correlated
from lapsekit.session import checkpoint_dir, write_shared


ROWS_PER_PART = 100_000
FEWEST_ROWS, SMALL_PARTS = 5_000, 32


def partitions_for(rows: int) -> int:
    """Parts of about 100,000 rows, of 5,000 while there are at most 32 of those. The rows alone decide: bagging and
    sums depend on the parts, and must not depend on the machine."""
    return max(1, math.ceil(rows / ROWS_PER_PART), min(SMALL_PARTS, rows // FEWEST_ROWS))


class ChurnStudy:
    """One analysis of one feature table; every step runs once, when first asked for.

    The features are written to the shared checkpoint folder up front, if the session
    names one: all later passes start from those Parquet files and not from the star join. ``counts`` holds
    rows, rows without a key and positive labels. They are then placed
    by key into ``partitions`` parts (chosen by size if not given), so that bagging
    and float sums see the rows in the same places however the input was laid out.
    Use it as a context manager, or call ``release``, to drop what it cached.
    """

    def __init__(
        self,
        features: DataFrame,
        key: str = "CustomerID",
        label: str = "label",
        seed: int = 12,
        train_share: float = 0.7,
        correlation_limit: float = 0.9,
        significance: float = 0.05,
        folds: int = 3,
        parallelism: int = 4,
        partitions: int | None = None,
    ):
        self.key, self.label, self.seed = key, label, seed
        self.train_share, self.folds, self.parallelism = train_share, folds, parallelism
        self.correlation_limit, self.significance = correlation_limit, significance
        self.partitions = partitions
        self._source = features
        self._cached: list[DataFrame] = []
        self._fits: dict[str, Fitted] = {}

    def __enter__(self) -> ChurnStudy:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def release(self) -> None:
        for df in self._cached:
            df.unpersist()
        self._cached.clear()

    def _keep(self, df: DataFrame) -> DataFrame:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._cached.append(kept)
        return kept

    @cached_property
    def features(self) -> DataFrame:
        if checkpoint_dir(self._source.sparkSession):
            written = write_shared(self._source, "features")
        else:
            written = self._keep(self._source)
        # Two columns of the written files. An Observation on the write would save even that, but a session that has
        # one can no longer send a fitted LogisticRegressionModel to its tasks: the training summary holds the session.
        counts = written.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(quote(self.key)).isNull()).alias("n_null_keys"),
            F.count_if(F.col(quote(self.label)) == 1).alias("n_positive"),
        )
        self.counts = counts.first().asDict()
        parts = self.partitions or partitions_for(self.counts["n_rows"])
        return self._keep(written.repartition(parts, self.key).sortWithinPartitions(self.key))

    @cached_property
    def _sides(self) -> tuple[DataFrame, DataFrame]:
        return train_test(self.features, self.key, self.seed, self.train_share)

    @property
    def train(self) -> DataFrame:
        return self._sides[0]

    @property
    def test(self) -> DataFrame:
        return self._sides[1]

    @cached_property
    def candidates(self) -> list[str]:
        return numeric_columns(self.features, exclude=[self.key, self.label])

    @cached_property
    def correlations(self) -> np.ndarray:
        return correlation(self.train, self.candidates)

    @cached_property
    def uncorrelated(self) -> list[str]:
        return prune_correlated(self.correlations, self.candidates, self.correlation_limit)

    @cached_property
    def selected(self) -> list[str]:
        sums = moments(self.train, self.uncorrelated, self.label)
        return eliminate_backward(sums, self.significance)

    @cached_property
    def plan(self) -> FeaturePlan:
        return FeaturePlan(tuple(text_columns(self.features)), tuple(self.selected))

    @cached_property
    def prepared(self) -> PipelineModel:
        return Pipeline(stages=self.plan.stages()).fit(self.train)

    @cached_property
    def vectors(self) -> tuple[DataFrame, DataFrame]:
        """Prepared train and test vectors; preparation is fitted on train alone."""
        train, test = (vectors_only(self.prepared, side, self.key, self.label) for side in self._sides)
        return self._keep(train), self._keep(test)

    def fit(self, name: str) -> Fitted:
        """Fit one of ``CLASSIFIERS``; preparation is shared between them."""
        if name not in self._fits:
            self._fits[name] = fit_predict(CLASSIFIERS[name](self.label), *self.vectors)
        return self._fits[name]

    def comparison(self, beta: float = 1.0) -> DataFrame:
        return compare({name: self.fit(name) for name in CLASSIFIERS}, beta, self.label)

    def report(self, name: str, beta: float = 1.0) -> DataFrame:
        return report(name, self.fit(name), beta, self.label)

    def tuned_comparison(self, beta: float = 1.0) -> DataFrame:
        """The tuned model on train and test. Counting and ranking read the predictions, which are made once and kept."""
        used = [self.label, "prediction", "rawPrediction"]
        sides = (self._keep(self.tuned.model.transform(side).select(*used)) for side in self._sides)
        return report("tuned_forest", Fitted(self.tuned.model, *sides, self.tuned.seconds), beta, self.label)

    @cached_property
    def tuned(self) -> Tuned:
        used = [self.key, self.label, *self.plan.categorical, *self.plan.numeric]
        folded = with_folds(self.train.select(*used), self.key, self.seed, self.folds).persist()
        try:
            return tune_forest(
                folded, self.plan, seed=self.seed, parallelism=self.parallelism, label=self.label, folds=self.folds
            )
        finally:
            folded.unpersist()

    def predictions(self) -> DataFrame:
        return score(self.tuned.model, self.features, self.key, self.label)

    def scores(self) -> DataFrame:
        return churn_scores(self.tuned.model, self.features, self.key)

    def scored_features(self) -> DataFrame:
        return with_scores(self.features, self.scores(), self.key)

    def correlations_of_selected(self) -> DataFrame:
        """Correlation of the selected columns over all customers, as (i, j, col_i, col_j, r)."""
        return correlation_pairs(self.features, self.selected)

    def skipped(self) -> DataFrame:
        """How many customers have no score: a category is missing, or did not occur on the training side."""
        known = {}
        for stage in self.prepared.stages:
            if isinstance(stage, StringIndexerModel):
                known |= dict(zip(stage.getInputCols(), stage.labelsArray, strict=True))
        fits = F.lit(True)
        for name, labels in known.items():
            fits = fits & F.coalesce(F.col(quote(name)).isin(list(labels)), F.lit(False))
        return self.features.agg(F.count_if(~fits).alias("n_skipped"), F.count(F.lit(1)).alias("n_customers"))
