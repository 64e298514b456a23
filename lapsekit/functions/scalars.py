"""Typing, recoding and labelling expressions that never throw on dirty text.

Spark 4 runs in ANSI mode, where a plain cast of ``'NA'`` aborts the job. Every
conversion of raw text below therefore goes through ``try_cast``/``try_to_date``
and turns unreadable values into NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_integer(c: ColumnLike) -> Column:
    """Text to int, cutting off decimals: ``'3.7'`` gives 3, ``'NA'`` gives NULL."""
    return _col(c).try_cast("double").try_cast("int")


def to_double(c: ColumnLike) -> Column:
    return _col(c).try_cast("double")


def to_moment(c: ColumnLike, fmt: str | None = None) -> Column:
    """Text in ``fmt`` (ISO without it) to a timestamp without time zone, NULL when unreadable."""
    if fmt is None:
        return _col(c).try_cast("timestamp_ntz")
    return F.try_to_timestamp(_col(c), F.lit(fmt)).cast("timestamp_ntz")


def parse_date(c: ColumnLike, fmt: str | None = None) -> Column:
    """Date of a text in ``fmt`` (ISO without it), or of a date/timestamp; bad input gives NULL."""
    if fmt is None:
        return _col(c).try_cast("date")
    return F.try_to_date(_col(c), fmt)


def days_between(end: ColumnLike, start: ColumnLike) -> Column:
    """Whole days from ``start`` to ``end``; negative when ``end`` comes first."""
    return F.datediff(F.to_date(_col(end)), F.to_date(_col(start)))


def recode(c: ColumnLike, mapping: Mapping[str, str]) -> Column:
    """Replace the given values; every other value, NULL included, stays."""
    column = _col(c)
    if not mapping:
        return column
    cases = None
    for old, new in mapping.items():
        test = column == F.lit(old)
        cases = F.when(test, F.lit(new)) if cases is None else cases.when(test, F.lit(new))
    return cases.otherwise(column)


def measure_or_zero(c: ColumnLike) -> Column:
    """Numeric reading of a measure with 0.0 where it is missing or unreadable."""
    return F.coalesce(to_double(c), F.lit(0.0))


def date_or(c: ColumnLike, fallback: ColumnLike, fmt: str | None = None) -> Column:
    """Date of ``c``, or the date of ``fallback`` where ``c`` is missing or unreadable."""
    return F.coalesce(parse_date(c, fmt), F.to_date(_col(fallback)))


def churn_flag(renewal: ColumnLike, end: ColumnLike, sentinel: str, current_year: int) -> Column:
    """1 when there is no renewal and the last period ended in another year, else 0.

    A NULL renewal text or end date leaves the condition unknown, which counts as 0.
    """
    lapsed = (_col(renewal) == F.lit(sentinel)) & (F.year(_col(end)) != F.lit(current_year))
    return F.when(lapsed, 1).otherwise(0)


def tag(prefix: str, c: ColumnLike) -> Column:
    """``prefix`` glued to the text of ``c``; NULL stays NULL."""
    return F.concat(F.lit(prefix), _col(c).cast("string"))


def row_sum(cols: Iterable[ColumnLike]) -> Column:
    """Sum across columns of one row, counting NULL as 0."""
    return reduce(add, [F.coalesce(_col(c), F.lit(0)) for c in cols])


def positive_probability(c: ColumnLike) -> Column:
    """Second entry of a class-probability vector, as float, without a Python worker."""
    return vector_to_array(_col(c))[1].cast("float")
