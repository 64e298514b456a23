"""Column-level building blocks; everything here stays inside the JVM."""

from lapsekit.functions.scalars import (
    churn_flag,
    days_between,
    date_or,
    measure_or_zero,
    parse_date,
    positive_probability,
    recode,
    row_sum,
    tag,
    to_double,
    to_integer,
    to_moment,
)

__all__ = [
    "churn_flag",
    "days_between",
    "date_or",
    "measure_or_zero",
    "parse_date",
    "positive_probability",
    "recode",
    "row_sum",
    "tag",
    "to_double",
    "to_integer",
    "to_moment",
]
