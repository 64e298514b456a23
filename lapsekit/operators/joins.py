"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsekit.functions.naming import quote
from lapsekit.session import checkpoint_dir, write_shared

BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
SALTS = 64
HOT_SHARE = 0.005


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes.

    Rows are counted first, which needs no column; bytes are measured only of a side with few enough rows. Each task
    sends one number.
    """
    width = F.lit(16 * len(df.columns)).cast("bigint")
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(quote(f.name)), F.lit(0))
        elif not isinstance(f.dataType, T.AtomicType):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(quote(f.name)).alias("c")))), F.lit(0))
    if df.agg(F.count(F.lit(1))).first()[0] > rows:
        return False
    return (df.agg(F.sum(width)).first()[0] or 0) <= size


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys holding about ``share`` of the rows or more, from one sketch aggregate.

    At most ``2 / share`` values reach the driver whatever the data. The sketch
    only picks which keys get salted; a missed or extra key changes no result.
    """
    wanted = int(2 / share)
    row = df.agg(
        F.expr(f"approx_top_k({quote(key)}, {wanted}, {max(10_000, wanted)})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    floor = row["n"] * share
    return [item["item"] for item in row["top"] or [] if item["item"] is not None and item["count"] >= floor]


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    hot: Iterable,
    row_id: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join that spreads the ``hot`` keys of ``fact`` over ``salts`` tasks each.

    The salt is a hash of ``row_id``, columns that tell the rows apart: rows that are
    alike otherwise are spread as well, and a task that is run again salts its rows
    the same way. Only the few ``dim`` rows of hot keys are repeated. NULL keys match
    nothing and are spread too, so they cannot pile up in one task of a left join.
    """
    check_how(how)
    hot = list(hot)
    spread = F.pmod(F.xxhash64(*[quote(c) for c in row_id]), F.lit(salts)).cast("int")
    is_hot = F.col(quote(key)).isin(hot) if hot else F.lit(False)
    left = fact.withColumn("_salt", F.when(F.col(quote(key)).isNull() | is_hot, spread).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = dim.withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def gathered(df: DataFrame, key: str, row_id: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Rows dealt by ``key``, for an aggregate whose buffers are wider than the rows.

    Where a key has its rows all over the table, combining on the map side holds and sends a buffer for nearly every
    row. Dealt first, a task holds one buffer a key. Hot keys go to ``salts`` tasks each by ``row_id``; only then does
    the aggregate need a second exchange, of one buffer per key and task.
    """
    hot = hot_keys(df, key)
    if not hot:
        return df.repartition(F.col(quote(key)))
    spread = F.pmod(F.xxhash64(*[quote(c) for c in row_id]), F.lit(salts)).cast("int")
    salt = F.when(F.col(quote(key)).isin(hot), spread).otherwise(0)
    return df.withColumn("_salt", salt).repartition(F.col(quote(key)), F.col("_salt")).drop("_salt")


def check_how(how: str) -> None:
    """Other joins would give the salted copies of ``dim`` rows of their own."""
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")


def attach(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    row_id: Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    write_fact: bool = False,
) -> DataFrame:
    """Left or inner join of ``dim`` onto ``fact``, whose rows ``row_id`` tells apart.

    ``dim`` is broadcast only after a count has shown that it is small in rows and
    bytes; a larger one is joined by shuffle with the hot keys of ``fact`` salted.
    ``write_fact`` is for few columns that are costly to make: the search for hot keys and the
    join then read them from the shared checkpoint folder, if the session names one.
    """
    check_how(how)
    if fits_broadcast(dim, broadcast_rows):
        return fact.join(F.broadcast(dim), [key], how)
    if write_fact and checkpoint_dir(fact.sparkSession):
        fact = write_shared(fact, "fact")
    return salted_join(fact, dim, key, hot_keys(fact, key), row_id, how)


def one_row_per_key(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``df`` at one row per key; the job fails if a key turns out to be repeated.

    The check rides on the aggregate whose exchange the following join on ``key``
    reuses, so it costs no job and no extra shuffle.
    """
    message = F.concat(F.lit(f"more than one row for {key} "), F.col(key).cast("string"))
    single = F.when(F.col("_rows") <= 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.max(c).alias(c) for c in cols], F.count(F.lit(1)).alias("_rows"))
        .where(single)
        .select(key, *cols)
    )


def left_star(base: DataFrame, blocks: Iterable[DataFrame], key: str) -> DataFrame:
    """Left-join blocks that each hold at most one row per key onto ``base``."""
    for block in blocks:
        base = base.join(block, [key], "left")
    return base
