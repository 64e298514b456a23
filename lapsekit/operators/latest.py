"""Latest row per key and de-duplication without a join or a window.

``max_by`` over structs combines on the map side, so a key that holds a third of
the table sends one row per input partition through the shuffle. A
``row_number`` window would bring the whole key to a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_struct(order: Sequence[str], attributes: Sequence[str]) -> Column:
    """Aggregate giving the ``attributes`` of the row that is last by ``order``.

    NULL sorts first inside a struct, so a dated row always beats an undated one.
    The attributes take part as last tie-breakers: the result depends on the data
    alone, never on the order in which rows arrive.
    """
    carried = list(dict.fromkeys([order[0], *attributes]))
    extra = [c for c in attributes if c not in order]
    return F.max_by(F.struct(*carried), F.struct(*order, *extra))


def unpack(struct_col: str, order: Sequence[str], attributes: Sequence[str]) -> list[Column]:
    """Columns of a ``latest_struct`` result; all NULL when the leading order value is NULL."""
    known = F.col(struct_col)[order[0]].isNotNull()
    return [F.when(known, F.col(struct_col)[c]).alias(c) for c in attributes]


def latest_per_key(df: DataFrame, key: str, order: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row per key with the attributes of its latest row (one shuffle, no join)."""
    best = df.groupBy(key).agg(latest_struct(order, attributes).alias("_last"))
    return best.select(key, *unpack("_last", order, attributes))


def dedup_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep the last row of every key under a total order."""
    rest = [c for c in df.columns if c != key]
    ranking = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*ranking)).alias("_last"))
    return best.select(key, *[F.col("_last")[c].alias(c) for c in rest]).select(*df.columns)


#: Above every 64-bit id twice over, below 10^20, so that a day's microseconds times it stay in 38 digits.
_ID_ROOM = "CAST(100000000000000000000 AS DECIMAL(21,0))"
_ID_SHIFT = "CAST(9223372036854775809 AS DECIMAL(20,0))"


def latest_flag(moment: str, id_col: str, flag: Column) -> Column:
    """Greatest (moment, id, flag) as one decimal: a plain maximum of fixed width.

    Unlike a struct, it fits the buffer of a hash aggregate, so no row is sorted
    before it is combined. Rows without a moment do not count; a NULL id is the
    least. The moment's year is 1 at least.
    """
    at = F.col(moment).cast("timestamp_ntz")
    second = F.date_part(F.lit("SECOND"), at).cast("decimal(8,6)") * 1_000_000
    days = F.datediff(at, F.lit("0001-01-01").cast("date")).cast("bigint")
    micros = (days * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60) * 1_000_000 + second.cast("bigint")
    number = F.coalesce(F.col(id_col).cast("decimal(20,0)") + F.expr(_ID_SHIFT), F.lit(0).cast("decimal(20,0)"))
    low = number * 2 + F.coalesce(flag.cast("int"), F.lit(0))
    return F.max((micros.cast("decimal(18,0)") * F.expr(_ID_ROOM) + low).cast("decimal(38,0)"))


def unpack_flag(packed: str) -> tuple[Column, Column]:
    """Year of the moment and the flag (0 or 1) of a ``latest_flag`` result; NULL without a moment."""
    days = F.expr(f"CAST(`{packed}` DIV {_ID_ROOM} DIV 86400000000L AS INT)")
    day = F.date_add(F.lit("0001-01-01").cast("date"), days)
    return F.year(day), (F.col(packed) % 2).cast("int")
