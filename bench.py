"""Times the headline queries and prints one JSON line.

Every relational query writes its full result to the ``noop`` sink. Model steps
run on one study, so each figure is that step alone (``*_fit_score`` is fit,
"""

from __future__ import annotations

import json
import os
import time

from lapsekit.models.classifiers import CLASSIFIERS
from lapsekit.operators.statistics import moments
from lapsekit.plans import catalogue
from lapsekit.session import local_session

RELATIONAL = (
    "latest_per_key",
    "churn_label",
    "category_counts",
    "measure_profile",
    "recency_duration",
    "yearly_frequency",
    "complaint_block",
    "delivery_block",
    "formula_block",
    "subscription_block",
    "fact_to_owner",
    "feature_table",
    "confusion_metrics",
    "class_density",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}

    def timed(name: str, step) -> None:
        start = time.monotonic()
        step()
        seconds[name] = round(time.monotonic() - start, 3)

    def sink(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    timed("session_warm_up", lambda: sink(spark.read.parquet(f"{folder}/orders.parquet")))
    study = catalogue.study(spark, folder)
    timed("feature_checkpoint", lambda: study.features.count())
    for name in RELATIONAL:
        timed(name, lambda name=name: sink(catalogue.QUERIES[name](spark, folder)))
    timed("corr_matrix", lambda: study.correlations)
    timed("gram_matrix", lambda: moments(study.train, study.candidates, study.label))
    timed("backward_elimination", lambda: study.selected)
    timed("prepared_vectors", lambda: [side.count() for side in study.vectors])
    for name in CLASSIFIERS:
        timed(f"{name}_fit_score", lambda name=name: study.report(name).collect())
    timed("cv_3_folds_4_grid_points", lambda: study.tuned)
    timed("score_customers", lambda: sink(study.scores()))
    timed("scored_table", lambda: sink(study.scored_features()))
    study.release()

    total = round(sum(v for k, v in seconds.items() if k != "session_warm_up"), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "churn_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
