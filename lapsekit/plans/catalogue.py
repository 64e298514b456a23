"""Named queries over the test tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.functions import (
    date_or,
    days_between,
    measure_or_zero,
    parse_date,
    positive_probability,
    row_sum,
    tag,
)
from lapsekit.models.classifiers import logistic_regression
from lapsekit.models.evaluate import confusion, evaluate, rank_auc
from lapsekit.models.prepare import FeaturePlan, scale_to_unit_std, string_index, vectors_only
from lapsekit.models.split import in_train, train_test, with_folds
from lapsekit.models.tuning import best_num_trees, grid_report
from lapsekit.operators import aggregates as agg
from lapsekit.operators import encode
from lapsekit.operators.columns import convert, fill_numeric, numeric_columns, recode_columns, rename, union_all
from lapsekit.operators.joins import attach
from lapsekit.operators.latest import dedup_key, latest_per_key
from lapsekit.operators.statistics import (
    class_curves,
    class_density,
    correlation_pairs,
    fit_rows,
    gram_pairs,
    moments,
    ols,
    prune_report,
)
from lapsekit.plans import blocks
from lapsekit.plans.features import feature_table
from lapsekit.plans.specs import EVENT_DATES, MEASURES, STANDIN
from lapsekit.plans.study import ChurnStudy
from lapsekit.sources import standin
from lapsekit.sources.readers import name_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY = STANDIN.key
SEED = 12
RULE_DAYS = 200
GRAM_FEATURES = ("TotalUrgent", "count_Price_Total", "NbDayLastRenewal", "Sub_2001", "STANDARD")
OLS_FEATURES = ("count_Price_Total", "NbDayLastRenewal", "STANDARD")
PRODUCT_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def query(fn: Query) -> Query:
    """Register under the function's name, without a trailing ``_query``."""
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


_studies: dict[tuple[str, str], ChurnStudy] = {}


def study(spark: SparkSession, folder: str) -> ChurnStudy:
    """The study of one folder, shared by the queries that report on its models. Another folder ends it."""
    at = (spark.sparkContext.applicationId, folder)
    if at not in _studies:
        release_studies()
        _studies[at] = ChurnStudy(_features(spark, folder), seed=SEED)
    return _studies[at]


def release_studies() -> None:
    """Lets go of what the study at hand has cached; the next query makes a new one."""
    for old in _studies.values():
        old.release()
    _studies.clear()


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return feature_table(standin.sources(spark, folder), STANDIN)


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.typed_subscriptions(standin.subscriptions(spark, folder), STANDIN)


def _train(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows, written out once because the statistics pass over them repeatedly."""
    return study(spark, folder).train


# ------------------------------------------------------------- sources and rows


@query
def scan_subscriptions(spark, folder):
    return standin.subscriptions(spark, folder)


@query
def view_sql(spark, folder):
    name_view(standin.subscriptions(spark, folder), "subscriptions_sql")
    return spark.sql(
        "SELECT ProductName, count(*) AS n_rows, count(EndDate) AS n_ended, max(StartDate) AS last_start "
        "FROM subscriptions_sql WHERE RenewalDate <> 'NA' GROUP BY ProductName"
    )


@query
def row_counts(spark, folder):
    return agg.row_counts(standin.sources(spark, folder))


@query
def project_cols(spark, folder):
    subs = standin.subscriptions(spark, folder)
    return subs.select(KEY, "StartDate", "EndDate", "RenewalDate", F.year("EndDate").alias("Year_EndDate"))


@query
def rename_map(spark, folder):
    subs = standin.subscriptions(spark, folder).select(KEY, "SubscriptionID", "ProductName", "TotalPrice")
    return rename(subs, {"ProductName": "Product", "TotalPrice": "Price_Text"})


@query
def recode_sentinel(spark, folder):
    return recode_columns(standin.complaints(spark, folder), STANDIN.complaint_recodes)


@query
def typed_cast(spark, folder):
    typed = convert(standin.subscriptions(spark, folder), {**MEASURES, **EVENT_DATES})
    return typed.select("SubscriptionID", *STANDIN.measure_names, *[n for n, _ in EVENT_DATES.values()])


@query
def fill_measure_zero(spark, folder):
    subs = standin.subscriptions(spark, folder)
    return subs.select("SubscriptionID", *[measure_or_zero(c).alias(c) for c in MEASURES])


@query
def date_fallback(spark, folder):
    subs = standin.subscriptions(spark, folder)
    return subs.select(
        "SubscriptionID",
        date_or("PaymentDate", "EndDate").alias("Date_Payment"),
        date_or("RenewalDate", "EndDate").alias("Date_Renewal"),
    )


@query
def parse_date_query(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    slashed = orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("text"), "o_orderstatus")
    dirty = slashed.withColumn("text", F.when(F.col("o_orderstatus") == "O", "NA").otherwise(F.col("text")))
    return dirty.select("o_orderkey", "text", parse_date("text", "yyyy/MM/dd").alias("day"))


@query
def days_between_query(spark, folder):
    subs = standin.subscriptions(spark, folder)
    return subs.select(
        "SubscriptionID",
        days_between("EndDate", "StartDate").alias("days_running"),
        days_between(F.lit(STANDIN.as_of), "EndDate").alias("days_since_end"),
    )


@query
def churn_label(spark, folder):
    return blocks.churn_labels(standin.subscriptions(spark, folder), STANDIN)


@query
def region_tag(spark, folder):
    return standin.customers(spark, folder).select(KEY, tag("Region", "Region").alias("Region_Cust"))


@query
def row_sum_query(spark, folder):
    typed = convert(standin.subscriptions(spark, folder), MEASURES)
    cols = ["Discount_Product", "Discount_Formula", "Discount_Total", "NbrMealsEXCEP"]
    return typed.select("SubscriptionID", row_sum(cols).cast("bigint").alias("total"))


@query
def na_fill(spark, folder):
    complaints = blocks.complaint_block(standin.complaints(spark, folder), STANDIN)
    customers = standin.customers(spark, folder).select(KEY)
    return fill_numeric(customers.join(complaints, [KEY], "left"))


@query
def one_hot(spark, folder):
    subs = standin.subscriptions(spark, folder).select("SubscriptionID", "ProductName")
    return encode.one_hot(subs, "ProductName", PRODUCT_LEVELS)


@query
def one_hot_found(spark, folder):
    return encode.one_hot(standin.formula(spark, folder), "FormulaType", prefix="type")


@query
def distinct_categories(spark, folder):
    return encode.distinct_categories(standin.delivery(spark, folder), "DeliveryTypeName")


@query
def union_all_query(spark, folder):
    subs = standin.subscriptions(spark, folder).select(KEY, F.col("StartDate").alias("day"), F.lit("start").alias("kind"))
    complaints = standin.complaints(spark, folder).select(
        F.lit("complaint").alias("kind"), KEY, F.col("ComplaintDate").alias("day")
    )
    return union_all(subs, complaints)


# ------------------------------------------------------------------------ joins


@query
def latest_per_key_query(spark, folder):
    subs = standin.subscriptions(spark, folder)
    attributes = ("SubscriptionID", "StartDate", "EndDate", "RenewalDate")
    return latest_per_key(subs, KEY, blocks.LATEST_ORDER, attributes)


@query
def dedup_key_query(spark, folder):
    subs = standin.subscriptions(spark, folder).select(KEY, "SubscriptionID", "StartDate", "ProductName")
    return dedup_key(subs, KEY, ("StartDate", "SubscriptionID"))


@query
def feature_inner(spark, folder):
    left = blocks.complaint_block(standin.complaints(spark, folder), STANDIN)
    right = blocks.customer_block(standin.customers(spark, folder), STANDIN)
    return left.join(right, [KEY]).select(KEY, "Region_Cust", "NbrTotalComplaints")


@query
def fact_to_owner(spark, folder):
    deliveries = standin.delivery(spark, folder, with_id=True)
    return attach(deliveries, standin.owners(spark, folder), "SubscriptionID", ["DeliveryID"]).drop("DeliveryID")


@query
def dim_lookup(spark, folder):
    subs = standin.subscriptions(spark, folder).select(KEY, "SubscriptionID", "FormulaID")
    return attach(subs, standin.formula(spark, folder), "FormulaID", ["SubscriptionID"])


@query
def dim_lookup_shuffled(spark, folder):
    subs = standin.subscriptions(spark, folder).select(KEY, "SubscriptionID", "FormulaID")
    return attach(subs, standin.formula(spark, folder), "FormulaID", ["SubscriptionID"], broadcast_rows=0)


# ------------------------------------------------------------------ aggregations


@query
def last_date(spark, folder):
    return agg.last_date(standin.complaints(spark, folder), KEY, "ComplaintDate", "last_complaint")


@query
def label_distribution(spark, folder):
    return agg.count_by(churn_label(spark, folder), "label")


@query
def count_two_keys(spark, folder):
    subs = standin.subscriptions(spark, folder).select(KEY, F.year("StartDate").alias("year"))
    return agg.count_by(subs, KEY, "year")


@query
def measure_profile(spark, folder):
    return _typed(spark, folder).groupBy(KEY).agg(*blocks.profile_of(STANDIN))


@query
def measure_profile_zero(spark, folder):
    typed = convert(standin.subscriptions(spark, folder), MEASURES)
    zeroed = typed.withColumns({c: measure_or_zero(c) for c in STANDIN.measure_names})
    cols = STANDIN.measure_names
    return agg.measure_profile(zeroed, KEY, cols, counted=cols, exact_scale=STANDIN.exact_scale)


@query
def recency_duration(spark, folder):
    recencies = {"Date_Payment": "NbDayLastPayment", "Date_Renewal": "NbDayLastRenewal"}
    exprs = agg.tenure_exprs(
        "StartDate", "EndDate", STANDIN.as_of, recencies, "AggSubscriptionDuration", span="SpanDays"
    )
    return _typed(spark, folder).groupBy(KEY).agg(*exprs)


@query
def category_counts(spark, folder):
    return encode.category_counts(standin.subscriptions(spark, folder), KEY, "ProductName", STANDIN.products)


@query
def sum_all_numeric(spark, folder):
    delivery = standin.delivery(spark, folder).drop("DeliveryDate")
    dummies = encode.one_hot(delivery, "DeliveryClass", ("F", "O"), "class")
    dummies = encode.one_hot(dummies, "DeliveryTypeName", ("A", "R", None), "type")
    return agg.sum_numeric(dummies, "SubscriptionID")


@query
def pivot_year(spark, folder):
    counts = count_two_keys(spark, folder)
    return encode.pivot_sum(counts, KEY, "year", "count", {y: f"y{y}" for y in (*STANDIN.years, 2002)})


@query
def pivot_formula(spark, folder):
    counts = agg.count_by(dim_lookup(spark, folder), KEY, "FormulaType")
    names = {**{t: t for t in STANDIN.formula_types}, None: "null"}
    return encode.pivot_sum(counts, KEY, "FormulaType", "count", names)


@query
def yearly_frequency(spark, folder):
    subs = standin.subscriptions(spark, folder)
    return agg.yearly_frequency(subs, KEY, "StartDate", STANDIN.years, "Sub_", "TotalSubscriptions")


# ------------------------------------------------------------------------ blocks


@query
def subscription_block(spark, folder):
    return blocks.subscription_block(standin.subscriptions(spark, folder), STANDIN)


@query
def complaint_block(spark, folder):
    return blocks.complaint_block(standin.complaints(spark, folder), STANDIN, true_count=True)


@query
def complaint_block_declared(spark, folder):
    """Only declared categories have columns; the others are counted together."""
    spec = replace(STANDIN, categories="declared")
    return blocks.complaint_block(standin.complaints(spark, folder), spec)


@query
def recency_slashed(spark, folder):
    """Recencies from payment and renewal dates written with slashes."""
    subs = standin.subscriptions(spark, folder)
    slashed = subs.withColumns({c: F.replace(c, F.lit("-"), F.lit("/")) for c in ("RenewalDate", "PaymentDate")})
    typed = blocks.typed_subscriptions(slashed, replace(STANDIN, date_format="yyyy/MM/dd"))
    recencies = {"Date_Payment": "NbDayLastPayment", "Date_Renewal": "NbDayLastRenewal"}
    exprs = agg.tenure_exprs("StartDate", "EndDate", STANDIN.as_of, recencies, "AggSubscriptionDuration", span="SpanDays")
    return typed.groupBy(KEY).agg(*exprs)


@query
def customer_block(spark, folder):
    return blocks.customer_block(standin.customers(spark, folder), STANDIN)


@query
def delivery_block(spark, folder):
    return blocks.delivery_block(standin.delivery(spark, folder), standin.owners(spark, folder), STANDIN)


@query
def formula_block(spark, folder):
    return blocks.formula_block(standin.subscriptions(spark, folder), standin.formula(spark, folder), STANDIN)


@query
def feature_table_query(spark, folder):
    return _features(spark, folder)


# -------------------------------------------------------------- rule evaluation


@query
def rule_predictions(spark, folder):
    """A fixed rule as the predictor: no renewal for a while means churn."""
    block = blocks.subscription_block(standin.subscriptions(spark, folder), STANDIN)
    late = F.coalesce(F.col("NbDayLastRenewal"), F.lit(0)) > RULE_DAYS
    return block.select(KEY, "label", F.when(late, 1.0).otherwise(0.0).alias("prediction"))


@query
def filter_pred(spark, folder):
    return rule_predictions(spark, folder).where((F.col("prediction") == 1) & (F.col("label") == 0))


@query
def confusion_metrics(spark, folder):
    scored = evaluate(rule_predictions(spark, folder), beta=2)
    names = ["accuracy", "precision", "recall", "f_beta", "auc_hard"]
    return scored.select("tp", "fp", "fn", "tn", *[F.round(n, 9).alias(n) for n in names])


@query
def auc_hard(spark, folder):
    return evaluate(rule_predictions(spark, folder)).select(F.round("auc_hard", 9).alias("auc_hard"))


# --------------------------------------------------------- split and statistics


@query
def split_members(spark, folder):
    customers = standin.customers(spark, folder)
    return customers.select(KEY, F.when(in_train(KEY, SEED), "train").otherwise("test").alias("side"))


@query
def fold_members(spark, folder):
    return with_folds(standin.customers(spark, folder).select(KEY), KEY, SEED, 3)


@query
def split_counts(spark, folder):
    train, test = train_test(churn_label(spark, folder), KEY, SEED)
    sides = union_all(train.withColumn("side", F.lit("train")), test.withColumn("side", F.lit("test")))
    return agg.count_by(sides, "side", "label")


@query
def corr_matrix(spark, folder):
    train = _train(spark, folder)
    return correlation_pairs(train, numeric_columns(train, exclude=[KEY, "label"]))


@query
def corr_prune(spark, folder):
    at = study(spark, folder)
    return prune_report(at.correlations, at.candidates, spark)


@query
def gram_matrix(spark, folder):
    return gram_pairs(_train(spark, folder), list(GRAM_FEATURES), "label")


@query
def ols_coefficients(spark, folder):
    fit = fit_rows(ols(moments(_train(spark, folder), OLS_FEATURES, "label")), spark)
    return fit.select(
        "feature",
        F.round("coefficient", 10).alias("coefficient"),
        F.round("std_error", 10).alias("std_error"),
        F.round("t_value", 6).alias("t_value"),
        F.round("p_value", 6).alias("p_value"),
    )


@query
def ols_summary(spark, folder):
    at = study(spark, folder)
    return fit_rows(ols(moments(at.train, at.uncorrelated, "label")), spark)


@query
def backward_elimination(spark, folder):
    at = study(spark, folder)
    return fit_rows(ols(moments(at.train, at.selected, "label")), spark)


@query
def feature_selection(spark, folder):
    plan = study(spark, folder).plan
    rows = [(c, "numeric") for c in plan.numeric] + [(c, "categorical") for c in plan.categorical]
    return spark.createDataFrame(rows, "feature string, kind string")


@query
def class_density_query(spark, folder):
    """Histograms of all numeric features."""
    at = study(spark, folder)
    return class_density(at.features, "label", at.candidates)


@query
def class_density_curves(spark, folder):
    """Kernel densities of all numeric features."""
    at = study(spark, folder)
    return class_curves(at.features, "label", at.candidates)


@query
def corr_given(spark, folder):
    """Correlation of given columns over all customers."""
    return correlation_pairs(study(spark, folder).features, list(GRAM_FEATURES))


@query
def feature_counts(spark, folder):
    """Rows, rows without a key and churners of the written features, as the study has counted them."""
    at = study(spark, folder)
    rows = at.features.limit(0).agg(F.count(F.lit(1)).alias("none"))
    return rows.select(*[F.lit(at.counts[c]).cast("long").alias(c) for c in ("n_rows", "n_null_keys", "n_positive")])


@query
def rank_sum_auc(spark, folder):
    """How well each numeric feature alone ranks the churners, all in one pass."""
    at = study(spark, folder)
    plain = at.features.select("label", *[F.col(c).cast("double").alias(c) for c in at.candidates])
    return rank_auc(plain.unpivot(["label"], at.candidates, "feature", "value"), "value", "label", ["feature"], digits=9)


# ------------------------------------------------------------------------ models


@query
def string_index_query(spark, folder):
    regions = blocks.customer_block(standin.customers(spark, folder), STANDIN)
    return string_index(regions, "Region_Cust", "Region_idx")


@query
def scale_unit_std(spark, folder):
    at = study(spark, folder)
    scaled = scale_to_unit_std(at.features, at.candidates, "scaled").select(KEY, vector_to_array("scaled").alias("a"))
    return scaled.select(KEY, *[F.round(F.col("a")[i], 6).alias(c) for i, c in enumerate(at.candidates)])


@query
def feature_vectors(spark, folder):
    train, test = study(spark, folder).vectors
    both = union_all(train, test)
    return both.select(KEY, "label", F.size(vector_to_array("features")).alias("n_values"))


@query
def assembled_vectors(spark, folder):
    """The prepared vectors of the region and given columns, a row for each place."""
    at = study(spark, folder)
    plan = FeaturePlan(("Region_Cust",), OLS_FEATURES)
    found = vectors_only(Pipeline(stages=plan.stages()).fit(at.train), at.features, KEY)
    places = found.select(KEY, F.posexplode(vector_to_array("features")).alias("position", "value"))
    return places.withColumn("value", F.round("value", 6))


@query
def region_model(spark, folder):
    """Churn probability by region from a logistic regression on region dummies: the share of churners there."""
    at = study(spark, folder)
    plan = FeaturePlan(("Region_Cust",), ())
    model = Pipeline(stages=[*plan.stages(), logistic_regression().setTol(1e-7)]).fit(at.train)
    scored = model.transform(at.train).groupBy("Region_Cust").agg(F.max(vector_to_array("probability")[1]).alias("p"))
    return scored.select("Region_Cust", F.round("p", 3).alias("churn_rate"))


@query
def model_logreg(spark, folder):
    return study(spark, folder).report("logistic_regression")


@query
def model_tree(spark, folder):
    return study(spark, folder).report("decision_tree")


@query
def model_forest(spark, folder):
    return study(spark, folder).report("random_forest")


@query
def model_comparison(spark, folder):
    return study(spark, folder).comparison()


@query
def model_row_totals(spark, folder):
    """Rows and churners behind each model's confusion counts: none may get lost."""
    counted = model_comparison(spark, folder)
    return counted.select(
        "model",
        "split",
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_rows"),
        (F.col("tp") + F.col("fn")).alias("n_churned"),
    )


@query
def tuned_comparison(spark, folder):
    return study(spark, folder).tuned_comparison()


@query
def tuned_row_totals(spark, folder):
    """Rows and churners behind the tuned model's confusion counts."""
    return tuned_comparison(spark, folder).select(
        "split",
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_rows"),
        (F.col("tp") + F.col("fn")).alias("n_churned"),
    )


@query
def corr_selected(spark, folder):
    """Correlation of the selected columns over all customers."""
    return study(spark, folder).correlations_of_selected()


@query
def score_totals(spark, folder):
    """Customers with a score, without one, and with one that is no probability."""
    p = F.col("Proba_churn")
    return study(spark, folder).scored_features().agg(
        F.count(p).alias("n_scored"),
        F.count_if(p.isNull()).alias("n_unscored"),
        F.count_if((p < 0) | (p > 1)).alias("n_invalid"),
    )


@query
def model_confusion(spark, folder):
    fitted = study(spark, folder).fit("decision_tree")
    sides = {"train": fitted.train, "test": fitted.test}
    return union_all(*[confusion(pred).withColumn("split", F.lit(side)) for side, pred in sides.items()])


@query
def churn_probability(spark, folder):
    fitted = study(spark, folder).fit("logistic_regression")
    both = union_all(fitted.train.withColumn("split", F.lit("train")), fitted.test.withColumn("split", F.lit("test")))
    return both.select(KEY, "split", "prediction", positive_probability("probability").alias("Proba_churn"))


@query
def cv_grid(spark, folder):
    return grid_report(study(spark, folder).tuned, spark)


@query
def cv_best(spark, folder):
    return spark.createDataFrame([(best_num_trees(study(spark, folder).tuned),)], "num_trees int")


@query
def score_customers(spark, folder):
    scored = study(spark, folder).predictions()
    return scored.withColumn("probability", vector_to_array("probability"))


@query
def churn_scores(spark, folder):
    return study(spark, folder).scores()


@query
def scored_flags(spark, folder):
    """All features, and whether the customer has a score."""
    scored = study(spark, folder).scored_features()
    return scored.withColumn("has_score", F.col("Proba_churn").isNotNull()).drop("Proba_churn")


@query
def skipped_customers(spark, folder):
    return study(spark, folder).skipped()


@query
def scored_table(spark, folder):
    return study(spark, folder).scored_features()
