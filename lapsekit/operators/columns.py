"""Projection-level operators: typing, renaming, filling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsekit.functions.naming import quote
from lapsekit.functions import measure_or_zero, recode, to_double, to_integer, to_moment

CONVERTERS = {"int": to_integer, "double": to_double, "moment": to_moment}


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns; a name that is not there is an error, not a silent no-op."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise ValueError(f"cannot rename absent columns: {missing}")
    return df.withColumnsRenamed(dict(mapping))


def recode_columns(df: DataFrame, recodes: Mapping[str, Mapping[str, str]]) -> DataFrame:
    return df.withColumns({c: recode(c, mapping) for c, mapping in recodes.items()})


def convert(
    df: DataFrame, measures: Mapping[str, tuple[str, str]], sentinel: str = "NA", date_format: str | None = None
) -> DataFrame:
    """Replace raw text columns by typed ones: ``{raw: (new name, int|double|moment)}``.

    One projection for all columns, so the plan does not grow a node per column.
    Unreadable text gives NULL in any case; taking the ``sentinel`` out beforehand
    spares the exception the number parser throws for each such value, which on
    files full of them costs more than the aggregate that follows. ``date_format``
    is that of moments in text columns.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    kept = [F.col(quote(c)) for c in df.columns if c not in measures]

    def source(raw: str) -> Column:
        is_text = isinstance(kinds[raw], T.StringType)
        return F.nullif(F.col(quote(raw)), F.lit(sentinel)) if is_text else F.col(quote(raw))

    def read(raw: str, kind: str) -> Column:
        if kind == "moment" and date_format and isinstance(kinds[raw], T.StringType):
            return to_moment(source(raw), date_format)
        return CONVERTERS[kind](source(raw))

    typed = [read(raw, kind).alias(name) for raw, (name, kind) in measures.items()]
    return df.select(*kept, *typed)


def as_measures(df: DataFrame, cols: Iterable[str], missing: str = "ignore") -> DataFrame:
    """Make measures double, keeping NULLs (``ignore``) or counting them as 0 (``zero``)."""
    if missing not in ("ignore", "zero"):
        raise ValueError(f"missing must be 'ignore' or 'zero', not {missing!r}")
    read = measure_or_zero if missing == "zero" else to_double
    return df.withColumns({c: read(c) for c in cols})


def fill_numeric(df: DataFrame, value: float = 0, special: Mapping[str, float] | None = None) -> DataFrame:
    """Fill NULLs of all numeric columns; text and dates are left alone."""
    if special:
        df = df.na.fill(dict(special))
    return df.na.fill(value)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def union_all(*frames: DataFrame, positional: bool = False) -> DataFrame:
    """Bag union of any number of frames, by name unless ``positional``."""
    if not frames:
        raise ValueError("union_all needs at least one frame")
    result = frames[0]
    for other in frames[1:]:
        result = result.union(other) if positional else result.unionByName(other)
    return result
