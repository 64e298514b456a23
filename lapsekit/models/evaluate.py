"""Classification metrics from one aggregate over the predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsekit.functions.naming import quote


def _cell(prediction: str, label: str, predicted: int, actual: int) -> Column:
    return F.count_if((F.col(prediction) == predicted) & (F.col(label) == actual))


def confusion(pred: DataFrame, prediction: str = "prediction", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn in one row per ``by``, from a single pass."""
    return pred.groupBy(*by).agg(
        _cell(prediction, label, 1, 1).alias("tp"),
        _cell(prediction, label, 1, 0).alias("fp"),
        _cell(prediction, label, 0, 1).alias("fn"),
        _cell(prediction, label, 0, 0).alias("tn"),
    )


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def metrics(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Scores from confusion counts.

    Precision, recall and F-beta are 0 where undefined; accuracy of nothing is
    NULL. ``auc_hard`` is the area under the ROC curve of the 0/1 predictions,
    which is (TPR + TNR) / 2; without negatives it is 1, without positives 0.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    weight = F.lit(float(beta) ** 2)
    scored = counts.withColumns(
        {
            "accuracy": F.try_divide((tp + tn).cast("double"), total.cast("double")),
            "precision": _or_zero(tp, tp + fp),
            "recall": _or_zero(tp, tp + fn),
        }
    )
    precision, recall = F.col("precision"), F.col("recall")
    both = (1 + weight) * precision * recall
    auc = (
        F.when(total == 0, F.lit(None).cast("double"))
        .when(tp + fn == 0, 0.0)
        .when(fp + tn == 0, 1.0)
        .otherwise((_or_zero(tp, tp + fn) + _or_zero(tn, tn + fp)) / 2)
    )
    return scored.withColumns({"f_beta": _or_zero(both, weight * precision + recall), "auc_hard": auc})


def evaluate(pred: DataFrame, beta: float = 1.0, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return metrics(confusion(pred, prediction, label), beta)


#: Scores are ranked within this many even steps, and the steps among each other.
STEPS = 4096


def rank_auc(pred: DataFrame, score: str, label: str = "label", by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Area under the ROC curve of scores, per ``by``: the share of (positive, negative) pairs in the right order, ties
    half. Any number of models or features is judged in one pass.

    Rows are counted per distinct score first. Negatives below a score are those of lower steps of its range, from
    one short list per ``by``, and those below within its step; no task sees all scores. NULL without both classes.
    """
    by = list(by)
    value, positive = F.col(quote(score)).cast("double"), F.col(quote(label)) == 1
    rows = pred.where(value.isNotNull() & F.col(quote(label)).isNotNull()).select(*by, value.alias("_s"), positive.cast("long").alias("_p"))
    counts = rows.groupBy(*by, "_s").agg(F.sum("_p").alias("_p"), F.sum(1 - F.col("_p")).alias("_n"))
    if by:
        spans = counts.groupBy(*by).agg(F.min("_s").alias("_low"), F.max("_s").alias("_high"))
        placed = counts.join(spans, by)
    else:
        span = counts.agg(F.min("_s"), F.max("_s")).first()
        placed = counts.withColumns({"_low": F.lit(span[0]).cast("double"), "_high": F.lit(span[1]).cast("double")})
    step = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_s") - F.col("_low")) / (F.col("_high") - F.col("_low")) * STEPS)).otherwise(0)
    placed = placed.withColumn("_step", step.cast("int"))
    before = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = placed.groupBy(*by, "_step").agg(F.sum("_n").alias("_in")).withColumn("_under", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    inside = Window.partitionBy(*by, "_step").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_below", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(steps.drop("_in"), [*by, "_step"])
    right = F.sum(F.col("_p") * (F.col("_under") + F.col("_below") + F.col("_n") / 2))
    area = F.try_divide(right, (F.sum("_p") * F.sum("_n")).cast("double"))
    return placed.groupBy(*by).agg((area if digits is None else F.round(area, digits)).alias("auc_score"))


def auc_of_scores(pred: DataFrame, label: str = "label") -> float:
    """Area under the ROC curve of one model's scores rather than its decisions."""
    scored = pred.select(F.col(label), positive_score().alias("score"))
    return rank_auc(scored, "score", label).first()[0]


def positive_score(raw: str = "rawPrediction") -> Column:
    """The raw score of class 1, as the ROC curve takes it."""
    return vector_to_array(raw)[1]
