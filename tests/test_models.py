import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.evaluation import BinaryClassificationMetrics
from pyspark.sql import functions as F

from lapsekit.models.classifiers import CLASSIFIERS, fit_predict, logistic_regression, report
from lapsekit.models import evaluate as evaluation
from lapsekit.models.evaluate import auc_of_scores, confusion, evaluate
from lapsekit.models.prepare import FeaturePlan, scale_to_unit_std, string_index
from lapsekit.models.scoring import churn_scores, score, with_scores
from lapsekit.models.split import in_train, random_train_test, train_test, with_folds
from lapsekit.models import tuning
from lapsekit.models.tuning import best_num_trees, grid_report, tune_forest
from lapsekit.plans import study as study_module
from lapsekit.plans.study import ChurnStudy, partitions_for
from lapsekit.session import checkpoint_dir


@pytest.fixture(scope="module")
def customers(spark):
    """400 customers; the label follows two columns, a third is noise, 40 lack a region."""
    noise = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 1000.0
    a = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0
    b = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000.0
    return (
        spark.range(0, 400, 1, 4)
        .select(
            F.col("id").alias("CustomerID"),
            a.alias("a"),
            b.alias("b"),
            noise.alias("noise"),
            (2 * a).alias("twice_a"),
            F.when(F.col("id") % 10 != 0, F.concat(F.lit("Region"), F.col("id") % 3)).alias("Region_Cust"),
        )
        .withColumn("label", ((F.col("a") + F.col("b") + 0.3 * F.col("noise")) > 1.25).cast("int"))
    )


def as_pairs(df):
    return {tuple(r) for r in df.collect()}


def test_split_does_not_depend_on_partitioning(customers):
    sides = [as_pairs(customers.repartition(n).select("CustomerID", in_train("CustomerID", 12))) for n in (1, 3, 7)]
    assert sides[0] == sides[1] == sides[2]
    train, test = train_test(customers, "CustomerID", 12)
    assert train.count() + test.count() == 400 and 240 < train.count() < 320
    assert as_pairs(train.select("CustomerID")) & as_pairs(test.select("CustomerID")) == set()
    other = as_pairs(customers.select("CustomerID", in_train("CustomerID", 13)))
    assert other != sides[0]


def test_random_split_is_available(customers):
    train, test = random_train_test(customers, 12)
    assert train.count() + test.count() == 400


def test_folds_cover_every_row(customers):
    folds = with_folds(customers, "CustomerID", 12, 3).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2] and sum(r["count"] for r in folds) == 400


@pytest.mark.parametrize(
    "pairs",
    [
        [(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)],
        [(0, 1), (0, 0)],
        [(1, 1), (0, 1)],
        [(1, 0), (0, 0)],
        [(1, 1), (1, 0)],
    ],
)
def test_hard_auc_matches_the_curve_area(spark, pairs):
    pred = spark.createDataFrame([(float(p), y) for p, y in pairs], "prediction double, label int")
    got = evaluate(pred).first()
    curve = BinaryClassificationMetrics(spark.sparkContext.parallelize([(float(p), float(y)) for p, y in pairs]))
    assert got["auc_hard"] == pytest.approx(curve.areaUnderROC)
    assert got["tp"] + got["fp"] + got["fn"] + got["tn"] == len(pairs)


def test_scores_are_guarded(spark):
    schema = "prediction double, label int"
    never = evaluate(spark.createDataFrame([(0.0, 1), (0.0, 0)], schema)).first()
    assert (never["precision"], never["recall"], never["f_beta"], never["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    empty = evaluate(spark.createDataFrame([], schema)).first()
    assert empty["tp"] == 0 and empty["accuracy"] is None and empty["precision"] == 0.0
    some = evaluate(spark.createDataFrame([(1.0, 1), (1.0, 1), (1.0, 0), (0.0, 1)], schema), beta=2).first()
    assert some["f_beta"] == pytest.approx(5 * (2 / 3) * (2 / 3) / (4 * (2 / 3) + 2 / 3))


def test_confusion_reads_predictions_once(spark):
    pred = spark.createDataFrame([(1.0, 1)], "prediction double, label int")
    plan = confusion(pred)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_index_and_scale(customers):
    indexed = string_index(customers, "Region_Cust", "idx")
    assert indexed.count() == 360 and indexed.select("idx").distinct().count() == 3
    scaled = scale_to_unit_std(customers, ["a", "b"], "s").select("a", vector_to_array("s")[0].alias("s"))
    std = customers.agg(F.stddev_samp("a")).first()[0]
    assert all(r["s"] == pytest.approx(r["a"] / std) for r in scaled.collect())


def test_merged_stages_equal_one_pair_per_column(customers):
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    stages = [
        StringIndexer(inputCol="Region_Cust", outputCol="i", handleInvalid="skip"),
        OneHotEncoder(inputCols=["i"], outputCols=["r"]),
    ]
    for c in ("a", "b"):
        stages += [VectorAssembler(inputCols=[c], outputCol=c + "v"), StandardScaler(inputCol=c + "v", outputCol=c + "s")]
    stages.append(VectorAssembler(inputCols=["r", "as", "bs"], outputCol="features"))
    merged = FeaturePlan(("Region_Cust",), ("a", "b")).stages()
    got, want = (
        {r[0]: r[1] for r in Pipeline(stages=s).fit(customers).transform(customers)
         .select("CustomerID", vector_to_array("features")).collect()}
        for s in (merged, stages)
    )
    assert got == want


def test_feature_plan_needs_columns():
    with pytest.raises(ValueError):
        FeaturePlan((), ()).stages()


@pytest.fixture(scope="module")
def study(customers):
    with ChurnStudy(customers) as s:
        yield s


def test_selection(study):
    assert "twice_a" in study.candidates and "twice_a" not in study.uncorrelated
    assert set(study.selected) <= set(study.uncorrelated) and study.selected
    assert study.plan.categorical == ("Region_Cust",)
    assert tuple(study.skipped().first()) == (40, 400)


def test_three_models_and_their_report(study):
    table = study.comparison().collect()
    assert {(r["model"], r["split"]) for r in table} == {(m, s) for m in CLASSIFIERS for s in ("train", "test")}
    n = {r["split"]: r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in table}
    assert n["train"] + n["test"] == 360
    for r in table:
        assert 0.5 < r["auc_score"] <= 1 and 0 <= r["accuracy"] <= 1
    assert study.fit("decision_tree").seconds > 0


def test_logistic_regression_is_at_its_optimum(study):
    fitted = study.fit("logistic_regression")
    gap = fitted.train.select((F.col("label") - vector_to_array("probability")[1]).alias("g"), vector_to_array("features").alias("f"))
    size = len(gap.first()["f"])
    sums = gap.agg(F.sum("g"), *[F.sum(F.col("g") * F.col("f")[i]) for i in range(size)]).first()
    assert max(abs(v) for v in sums) < 1e-2
    wrong = fitted.test.where((F.col("prediction") == 1) != (vector_to_array("probability")[1] > 0.5))
    assert wrong.count() == 0


def test_models_do_not_depend_on_the_input_layout(customers):
    def outcome(n):
        with ChurnStudy(customers.repartition(n)) as s:
            scores = churn_scores(s.fit("random_forest").model, s.vectors[1], "CustomerID")
            return s.selected, {r[0]: round(r[1], 6) for r in scores.collect()}

    assert outcome(3) == outcome(7)


def test_tuning_and_scores(study, customers, spark):
    folded = with_folds(study.train, "CustomerID", 12, 3)
    tuned = tune_forest(folded, study.plan, num_trees=(3, 5), parallelism=2)
    again = tune_forest(folded, study.plan, num_trees=(3, 5), parallelism=1)
    assert tuned.folds.tolist() == again.folds.tolist()
    grid = grid_report(tuned, spark).collect()
    best = max(grid, key=lambda r: r["mean_auc"])["num_trees"]
    assert [r["num_trees"] for r in grid] == [3, 5] and best_num_trees(tuned) == best
    scores = churn_scores(tuned.model, customers, "CustomerID")
    assert scores.dtypes == [("CustomerID", "bigint"), ("Proba_churn", "float")]
    assert scores.count() == 360 and scores.where("Proba_churn < 0 or Proba_churn > 1").count() == 0
    assert "EvalPython" not in scores._jdf.queryExecution().executedPlan().toString()
    joined = with_scores(customers, scores, "CustomerID")
    assert joined.count() == 400 and joined.where("Proba_churn is null").count() == 40
    train, test = train_test(customers, "CustomerID", 12)
    apart = churn_scores(tuned.model, test, "CustomerID").unionAll(churn_scores(tuned.model, train, "CustomerID"))
    assert as_pairs(apart) == as_pairs(scores)
    assert score(tuned.model, customers, "CustomerID").columns == ["CustomerID", "prediction", "label", "probability"]


def test_tuning_ranks_scores_that_are_made_once(study, monkeypatch):
    """Ranking reads them in several stages, none of which may run the forests again."""
    plans = []
    ranked = tuning.rank_auc

    def watched(df, *args):
        plans.append(df._jdf.queryExecution().withCachedData().toString())
        return ranked(df, *args)

    monkeypatch.setattr(tuning, "rank_auc", watched)
    folded = with_folds(study.train, "CustomerID", 12, 3)
    tune_forest(folded, study.plan, num_trees=(3, 5), parallelism=2)
    assert len(plans) == 3 and all("InMemoryRelation [trees#" in p and p.count("InMemoryRelation [trees#") == 2 for p in plans)


def test_the_tuned_model_predicts_each_side_once(customers, monkeypatch):
    kept = []
    monkeypatch.setattr(study_module, "report", lambda name, fitted, *a: kept.extend([fitted.train, fitted.test]))
    with ChurnStudy(customers) as s:
        s.tuned_comparison()
        assert [df.storageLevel.useMemory for df in kept] == [True, True]
    assert [df.storageLevel.useMemory for df in kept] == [False, False]


def test_report_of_a_fit_on_plain_vectors(study):
    train, test = study.vectors
    fitted = fit_predict(logistic_regression(), train, test)
    got = report("again", fitted).collect()
    assert [r["split"] for r in got] == ["train", "test"]
    assert got[1]["auc_score"] == pytest.approx(auc_of_scores(fitted.test))


def test_rank_auc_equals_the_curve_area(study, spark, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    for name in ("logistic_regression", "decision_tree"):
        pred = study.fit(name).test
        assert auc_of_scores(pred) == pytest.approx(BinaryClassificationEvaluator(numBins=0).evaluate(pred), abs=1e-9)
    rows = [(m, float(i * i % 13) if m == "a" else 1.0, int(i % 3 == 0)) for m in "ab" for i in range(50)] + [("c", 1.0, 1), ("a", None, 1), ("a", 2.0, None)]
    df = spark.createDataFrame(rows, "m string, s double, y int")
    monkeypatch.setattr(evaluation, "STEPS", 3)
    got = {r.m: r.auc_score for r in evaluation.rank_auc(df, "s", "y", ["m"]).collect()}
    pos, neg = ([s for m, s, y in rows if m == "a" and y == k and s is not None] for k in (1, 0))
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert got == {"a": pytest.approx(want), "b": 0.5, "c": None}
    assert evaluation.rank_auc(df.where("false"), "s", "y").count() <= 1


@pytest.mark.parametrize("rows, parts", [(0, 1), (1500, 1), (15_000, 3), (160_000, 32), (10**7, 100), (10**9, 10_000)])
def test_parts_follow_the_rows_alone(rows, parts):
    assert partitions_for(rows) == parts


def test_another_label_name(customers):
    with ChurnStudy(customers.withColumnRenamed("label", "churned"), label="churned", folds=2) as s:
        assert {r["split"] for r in s.report("decision_tree").collect()} == {"train", "test"}
        assert s.report("decision_tree").first()["seconds"] > 0
        assert s.tuned_comparison().count() == 2 and s.scores().count() == 360


def test_a_category_of_the_test_side_alone_counts_as_skipped(customers):
    test_keys = [r[0] for r in train_test(customers.where("Region_Cust is not null"), "CustomerID", 12)[1].limit(5).collect()]
    odd = F.when(F.col("CustomerID").isin(test_keys), "RegionX").otherwise(F.col("Region_Cust"))
    with ChurnStudy(customers.withColumn("Region_Cust", odd)) as s:
        assert tuple(s.skipped().first()) == (45, 400)
        assert sum(v.count() for v in s.vectors) == 355


def test_checkpoints_follow_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert checkpoint_dir(spark) == (named or spark.sparkContext.getCheckpointDir())
