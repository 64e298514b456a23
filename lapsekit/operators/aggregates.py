"""Aggregates at key grain, as expression lists first.

Blocks over the same table put their expressions into a single ``groupBy``, which
Catalyst would not do for separate aggregates joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsekit.functions import days_between, row_sum
from lapsekit.operators.columns import numeric_columns


def rounded_mean(col: str, scale: int, exact_scale: int | None = None) -> Column:
    """Average of the non-null values, rounded half up.

    With ``exact_scale`` the values are summed as decimals of that many places, so that neither the order in which
    partitions arrive nor binary fractions move the last digit. A group with a value of more places, or of more than
    ten digits before the point, takes the plain average: no value is ever cut.
    """
    plain = F.round(F.avg(col), scale)
    if exact_scale is None:
        return plain
    exact = F.col(col).try_cast(f"decimal({exact_scale + 10},{exact_scale})")
    kept = F.col(col).isNull() | F.coalesce(exact.cast("double") == F.col(col), F.lit(False))
    mean = F.round(F.try_divide(F.sum(exact), F.count(col)), scale).cast("double")
    return F.when(F.bool_and(kept), mean).otherwise(plain)


def profile_exprs(
    cols: Iterable[str],
    scale: int = 2,
    counted: Sequence[str] = (),
    unrounded: Sequence[str] = (),
    exact_scale: Mapping[str, int] | None = None,
) -> list[Column]:
    """avg/max/min per measure, plus the non-null count for those in ``counted``."""
    exact = exact_scale or {}
    exprs: list[Column] = []
    for c in cols:
        top, low = F.max(c), F.min(c)
        if c not in unrounded:
            top, low = F.round(top, scale), F.round(low, scale)
        exprs.append(rounded_mean(c, scale, exact.get(c)).alias(f"avg_{c}"))
        exprs.append(top.alias(f"max_{c}"))
        exprs.append(low.alias(f"min_{c}"))
        if c in counted:
            exprs.append(F.count(c).alias(f"count_{c}"))
    return exprs


def measure_profile(df: DataFrame, key: str, cols: Iterable[str], **options) -> DataFrame:
    return df.groupBy(key).agg(*profile_exprs(cols, **options))


def tenure_exprs(
    start: str, end: str, as_of: date, recencies: Mapping[str, str], duration: str, span: str | None = None
) -> list[Column]:
    """Summed length of all periods and days since the latest of each dated event.

    ``recencies`` maps a date column to its output name. ``span`` adds the days from
    first start to last end, which is a different measure than the sum.
    """
    day = F.lit(as_of)
    exprs = [F.sum(days_between(end, start)).alias(duration)]
    exprs += [F.min(days_between(day, c)).alias(name) for c, name in recencies.items()]
    if span:
        exprs.append(F.datediff(F.to_date(F.max(end)), F.to_date(F.min(start))).alias(span))
    return exprs


def days_since_last(col: str, as_of: date) -> Column:
    """Days from the latest date of the group to ``as_of``; negative for later events."""
    return F.datediff(F.lit(as_of), F.to_date(F.max(col)))


def year_exprs(col: str, years: Iterable[int], prefix: str) -> list[Column]:
    return [F.count_if(F.year(col) == y).alias(f"{prefix}{y}") for y in years]


def yearly_frequency(
    df: DataFrame, key: str, col: str, years: Sequence[int], prefix: str, total: str
) -> DataFrame:
    """Rows per key and declared year, and their sum."""
    counts = df.groupBy(key).agg(*year_exprs(col, years, prefix))
    return counts.withColumn(total, row_sum([f"{prefix}{y}" for y in years]))


def last_date(df: DataFrame, key: str, col: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(col).alias(name))


def count_by(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def sum_numeric(df: DataFrame, key: str, cols: Sequence[str] | None = None, prefix: str = "sum_") -> DataFrame:
    """Sum of the numeric columns per key; the key itself is never summed."""
    cols = numeric_columns(df, exclude=[key]) if cols is None else cols
    return df.groupBy(key).agg(*[F.sum(c).alias(f"{prefix}{c}") for c in cols])


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per named frame with its number of rows."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in frames.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result

