"""The customer feature table: five blocks joined on the customer key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from lapsekit.functions.naming import quote
from lapsekit.operators.columns import fill_numeric
from lapsekit.operators.joins import BROADCAST_ROWS, left_star
from lapsekit.plans import blocks
from lapsekit.plans.specs import COUNTED, ChurnSpec


def profile_names(spec: ChurnSpec) -> list[str]:
    names = []
    for m in spec.measure_names:
        names += [f"avg_{m}", f"max_{m}", f"min_{m}"]
        if m in COUNTED:
            names.append(f"count_{m}")
    return names


def feature_names(spec: ChurnSpec) -> list[str]:
    """Columns of the feature table in order; correlation pruning depends on it."""
    names = [
        spec.key,
        *spec.products.values(),
        *profile_names(spec),
        "AggSubscriptionDuration",
        "NbDayLastPayment",
        "NbDayLastRenewal",
        "Region_Cust",
        "label",
        *blocks.complaint_names(spec),
        "NbrTotalComplaints",
        "NbDayLastComplaint",
        *blocks.delivery_names(spec),
        "NbDayLastDelivery",
        *spec.year_names,
        "TotalSubscriptions",
        *blocks.formula_names(spec).values(),
    ]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"feature names used twice: {repeated}")
    return names


def feature_table(
    tables: Mapping[str, DataFrame], spec: ChurnSpec, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per customer with a subscription, missing numbers filled.

    ``tables`` holds subscriptions, complaints, customers, delivery and formula,
    and may hold a cheaper ``owners`` view of (SubscriptionID, customer). Customers
    without complaints or deliveries get 0 (or ``recency_fill``) as recency.
    """
    subs, formula = tables["subscriptions"], tables["formula"]
    spec = blocks.with_formula_types(spec, formula)
    spec = blocks.with_found_categories(spec, tables["complaints"], tables["delivery"])
    owners = tables.get("owners", subs)
    right = [
        blocks.customer_block(tables["customers"], spec),
        blocks.complaint_block(tables["complaints"], spec),
        blocks.delivery_block(tables["delivery"], owners, spec),
    ]
    if blocks.formula_fits(formula, broadcast_rows):
        base = blocks.subscription_block(subs, spec, blocks.unique_formula(formula))
    else:
        base = blocks.subscription_block(subs, spec)
        right.append(blocks.formula_block(subs, formula, spec, broadcast_rows))
    special = {}
    if spec.recency_fill is not None:
        special = dict.fromkeys(["NbDayLastComplaint", "NbDayLastDelivery"], spec.recency_fill)
    return fill_numeric(left_star(base, right, spec.key), 0, special).select(
        *[quote(n) for n in feature_names(spec)]
    )
