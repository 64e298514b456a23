"""One block of customer-grain features per source table.

Each block filters, recodes and aggregates its table in a single ``groupBy`` on
the customer key. The exchange of that aggregate also serves the later left join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsekit.functions.naming import quote, safe
from lapsekit.functions import date_or, row_sum, tag
from lapsekit.operators.aggregates import days_since_last, profile_exprs, tenure_exprs, year_exprs
from lapsekit.operators.columns import as_measures, convert, recode_columns
from lapsekit.operators.encode import count_exprs, discover_categories, discover_each, dummy_name, undeclared
from lapsekit.operators.joins import BROADCAST_ROWS, attach, fits_broadcast, gathered, one_row_per_key
from lapsekit.operators.latest import latest_flag, unpack_flag
from lapsekit.plans.specs import COUNTED, EVENT_DATES, MEASURES, UNROUNDED, ChurnSpec

LATEST_ORDER = ("EndDate", "SubscriptionID")


def typed_subscriptions(subs: DataFrame, spec: ChurnSpec) -> DataFrame:
    """Subscriptions with typed measures and event dates.

    The renewal text stays under ``RenewalText``: the label tests its sentinel.
    """
    kept = subs.withColumn("RenewalText", F.col("RenewalDate"))
    typed = as_measures(
        convert(kept, {**MEASURES, **EVENT_DATES}, spec.sentinel, spec.date_format), spec.measure_names, spec.missing
    )
    if spec.end_fallback:
        dates = [name for name, _ in EVENT_DATES.values()]
        typed = typed.withColumns({d: date_or(d, "EndDate") for d in dates})
    return typed


def latest_renewal(spec: ChurnSpec) -> Column:
    """The latest subscription and whether its renewal is the sentinel, packed for a hash aggregate."""
    return latest_flag(*LATEST_ORDER, F.col("RenewalText") == spec.sentinel)


def latest_label(latest: str, spec: ChurnSpec) -> Column:
    year, lapsed = unpack_flag(latest)
    return F.when((lapsed == 1) & (year != spec.current_year), 1).otherwise(0).alias("label")


def churn_labels(subs: DataFrame, spec: ChurnSpec) -> DataFrame:
    """Customer and 0/1 label from the latest subscription."""
    rows = subs.select(spec.key, *LATEST_ORDER, F.col("RenewalDate").alias("RenewalText"))
    best = rows.groupBy(spec.key).agg(latest_renewal(spec).alias("_last"))
    return best.select(spec.key, latest_label("_last", spec))


def profile_of(spec: ChurnSpec) -> list[Column]:
    return profile_exprs(
        spec.measure_names, counted=COUNTED, unrounded=UNROUNDED, exact_scale=spec.exact_scale
    )


def tenure_of(spec: ChurnSpec) -> list[Column]:
    return tenure_exprs(
        "StartDate",
        "EndDate",
        spec.as_of,
        {"Date_Payment": "NbDayLastPayment", "Date_Renewal": "NbDayLastRenewal"},
        "AggSubscriptionDuration",
    )


def subscription_block(subs: DataFrame, spec: ChurnSpec, formula: DataFrame | None = None) -> DataFrame:
    """Product counts, measure statistics, tenure, label and yearly frequency.

    With ``formula`` (already known to be small enough to broadcast) the formula
    counts join the same aggregate and cost no further shuffle. Its buffers are several
    times as wide as a subscription, so the subscriptions are dealt by customer first.
    """
    rows = typed_subscriptions(subs, spec).where(F.col(spec.key).isNotNull())
    aggs = [
        *count_exprs("ProductName", spec.products),
        *profile_of(spec),
        *tenure_of(spec),
        latest_renewal(spec).alias("_last"),
        *year_exprs("StartDate", spec.years, "Sub_"),
    ]
    if formula is not None:
        rows = rows.join(F.broadcast(formula), ["FormulaID"], "left")
        aggs += count_exprs("FormulaType", formula_names(spec))
    block = gathered(rows, spec.key, ["SubscriptionID"]).groupBy(spec.key).agg(*aggs)
    return block.withColumns(
        {"label": latest_label("_last", spec), "TotalSubscriptions": row_sum(spec.year_names)}
    ).drop("_last")


def complaint_block(complaints: DataFrame, spec: ChurnSpec, true_count: bool = False) -> DataFrame:
    """Complaint counts per attribute value, their total, and days since the last one.

    The total adds the counts of all attributes, so a complaint enters it once per
    attribute; ``true_count`` adds the number of complaints as ``n_complaints``.
    """
    spec = complaint_spec(spec, complaints)
    counts = counting(spec, spec.complaint_counts)
    extra = [F.count(F.lit(1)).alias("n_complaints")] if true_count else []
    block = (
        recode_columns(complaints, spec.complaint_recodes)
        .where(F.col(spec.key).isNotNull())
        .groupBy(spec.key)
        .agg(*counts, days_since_last("ComplaintDate", spec.as_of).alias("NbDayLastComplaint"), *extra)
    )
    names = complaint_names(spec)
    added = [n for cats in spec.complaint_counts.values() for n in cats.values() if n not in spec.not_in_total]
    tail = ["NbDayLastComplaint", *(["n_complaints"] if true_count else [])]
    return block.select(spec.key, *map(quote, names), row_sum(map(quote, added)).alias("NbrTotalComplaints"), *tail)


def customer_block(customers: DataFrame, spec: ChurnSpec) -> DataFrame:
    """Region category per customer; a repeated customer fails the job."""
    single = one_row_per_key(customers, spec.key, ["Region"])
    return single.select(spec.key, tag(spec.region_prefix, "Region").alias("Region_Cust"))


def delivery_block(delivery: DataFrame, owners: DataFrame, spec: ChurnSpec) -> DataFrame:
    """Delivery counts per class and type, and days since the last delivery.

    Deliveries shrink to one row per subscription before they meet their owner, so
    neither a subscription nor a customer with a huge number of deliveries skews
    the join. Deliveries without an owner belong to no customer and drop out.
    """
    spec = delivery_spec(spec, delivery)
    names = delivery_names(spec)
    counts = counting(spec, spec.delivery_counts)
    per_subscription = (
        recode_columns(delivery, spec.delivery_recodes)
        .where(F.col("SubscriptionID").isNotNull())
        .groupBy("SubscriptionID")
        .agg(*counts, F.max("DeliveryDate").alias("_last"))
    )
    owned = owners.select("SubscriptionID", spec.key).where(F.col(spec.key).isNotNull())
    return (
        per_subscription.join(owned, ["SubscriptionID"])
        .groupBy(spec.key)
        .agg(
            *[F.sum(quote(n)).alias(n) for n in names],
            days_since_last("_last", spec.as_of).alias("NbDayLastDelivery"),
        )
    )


def formula_block(
    subs: DataFrame, formula: DataFrame, spec: ChurnSpec, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Subscriptions per customer and formula type.

    The subscription number comes along to spread a hot formula evenly: by customer
    alone, a customer that is hot as well would stay in one task.
    """
    rows = subs.select(spec.key, "SubscriptionID", "FormulaID").where(F.col(spec.key).isNotNull())
    typed = attach(
        rows, unique_formula(formula), "FormulaID", ["SubscriptionID"], broadcast_rows=broadcast_rows, write_fact=True
    )
    return typed.groupBy(spec.key).agg(*count_exprs("FormulaType", formula_names(spec)))


def unique_formula(formula: DataFrame) -> DataFrame:
    return one_row_per_key(formula, "FormulaID", ["FormulaType"])


def with_formula_types(spec: ChurnSpec, formula: DataFrame) -> ChurnSpec:
    """``spec`` with the formula types read from the table, unless declared."""
    if spec.formula_types:
        return spec
    return replace(spec, formula_types=tuple(discover_categories(formula, "FormulaType", spec.max_categories)))


def counting(spec: ChurnSpec, counts: Mapping) -> list[Column]:
    """Counts of the listed categories, and of all others where those get no columns of their own."""
    result = []
    for col, names in counts.items():
        result += count_exprs(col, names)
        if spec.categories == "declared":
            result.append(undeclared(col, names).alias(f"{col}_undeclared"))
    return result


def _names(spec: ChurnSpec, counts: Mapping) -> list[str]:
    result = []
    for col, names in counts.items():
        result += [*names.values(), *([f"{col}_undeclared"] if spec.categories == "declared" else [])]
    return result


def _extended(spec: ChurnSpec, df: DataFrame, recodes: Mapping, counts: Mapping) -> dict:
    """``counts`` with a column ``<column>_<category>`` for each category that occurs but is not declared."""
    found = discover_each(recode_columns(df, recodes), list(counts), spec.max_categories)
    return {col: {**names, **{c: dummy_name(col, c) for c in found[col] if c not in names}} for col, names in counts.items()}


def complaint_spec(spec: ChurnSpec, complaints: DataFrame) -> ChurnSpec:
    """``spec`` with the complaint categories found, unless it takes only declared ones. New ones stay out of the total."""
    if spec.categories != "found":
        return spec
    counts = _extended(spec, complaints, spec.complaint_recodes, spec.complaint_counts)
    new = [n for col, names in counts.items() for c, n in names.items() if c not in spec.complaint_counts[col]]
    return replace(spec, complaint_counts=counts, not_in_total=(*spec.not_in_total, *new))


def delivery_spec(spec: ChurnSpec, delivery: DataFrame) -> ChurnSpec:
    """``spec`` with the delivery categories found, unless it takes only declared ones."""
    if spec.categories != "found":
        return spec
    return replace(spec, delivery_counts=_extended(spec, delivery, spec.delivery_recodes, spec.delivery_counts))


def with_found_categories(spec: ChurnSpec, complaints: DataFrame, delivery: DataFrame) -> ChurnSpec:
    """``spec`` with all categories that occur, listed: nothing is left to look up."""
    found = complaint_spec(spec, complaints)
    found = delivery_spec(found, delivery)
    return replace(found, categories="listed") if spec.categories == "found" else spec


def formula_names(spec: ChurnSpec) -> dict[str, str]:
    """Formula types as column names; ML reads a dot as nesting, so it becomes ``_``."""
    return {t: safe(t) for t in spec.formula_types}


def complaint_names(spec: ChurnSpec) -> list[str]:
    return _names(spec, spec.complaint_counts)


def delivery_names(spec: ChurnSpec) -> list[str]:
    return _names(spec, spec.delivery_counts)


def formula_fits(formula: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return fits_broadcast(formula.select("FormulaID", "FormulaType"), rows)
