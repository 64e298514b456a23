"""Categories to columns: dummies, conditional counts and pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsekit.functions.naming import quote, safe


def distinct_categories(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def discover_categories(df: DataFrame, col: str, limit: int = 1000) -> list:
    """Sorted non-null categories; more than ``limit`` of them is an error.

    The result becomes column names, so its size has to be bounded before it
    reaches the driver.
    """
    found = distinct_categories(df.where(F.col(col).isNotNull()), col).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{col} has more than {limit} categories")
    return sorted(r[0] for r in found)


def discover_each(df: DataFrame, cols: Sequence[str], limit: int = 1000) -> dict[str, list]:
    """``discover_categories`` of several columns at once, as text, without a row for each value.

    A first aggregate sketches how many values each column has, and a column far beyond ``limit`` is refused there; a
    second one gathers the values, of which there are few by then. Both are combined on the map side.
    """
    text = {f"c{i}": F.col(quote(c)).cast("string") for i, c in enumerate(cols)}
    plain = df.select(*[v.alias(n) for n, v in text.items()])
    about = plain.agg(*[F.approx_count_distinct(n, 0.02).alias(n) for n in text]).first()
    sizes = dict(zip(cols, about, strict=True))
    for c in cols:
        if sizes[c] > 1.2 * limit + 10:
            raise ValueError(f"{c} has more than {limit} categories")
    found = plain.agg(*[F.collect_set(n).alias(n) for n in text]).first()
    result = {c: sorted(values) for c, values in zip(cols, found, strict=True)}
    for c, values in result.items():
        if len(values) > limit:
            raise ValueError(f"{c} has more than {limit} categories")
    return result


def matches(col: str, category) -> Column:
    """Equality with a category; ``None`` stands for the NULL bucket."""
    return F.col(quote(col)).isNull() if category is None else F.col(quote(col)) == F.lit(category)


def dummy_name(prefix: str, category) -> str:
    return safe(f"{prefix}_{'null' if category is None else category}")


def one_hot(
    df: DataFrame,
    col: str,
    categories: Sequence | None = None,
    prefix: str | None = None,
    max_categories: int = 1000,
) -> DataFrame:
    """Append a 0/1 column per category, named after its source column.

    Declared categories keep the schema fixed and build no job.
    """
    if categories is None:
        categories = discover_categories(df, col, max_categories)
    prefix = col if prefix is None else prefix
    return df.withColumns(
        {dummy_name(prefix, c): F.when(matches(col, c), 1).otherwise(0) for c in categories}
    )


def count_exprs(col: str, names: Mapping) -> list[Column]:
    """Rows per category as aggregates: ``{category: output name}``."""
    return [F.count_if(matches(col, c)).alias(name) for c, name in names.items()]


def undeclared(col: str, names: Mapping) -> Column:
    """Rows of a category that ``names`` does not list; NULL is no category."""
    return F.count_if(F.col(quote(col)).isNotNull() & ~F.col(quote(col)).isin(list(names)))


#: More declared categories than this are looked up in a map for each key, instead of a conditional for each row.
CONDITIONALS = 100


def _by_map(df: DataFrame, key: str, col: str, amount: Column, names: Mapping) -> DataFrame:
    """Per key the ``amount`` of each declared category, from (key, category) sums gathered into one map a key."""
    listed = F.col(quote(col)).isin([c for c in names if c is not None])
    listed = listed | F.col(quote(col)).isNull() if None in names else listed
    wanted = F.when(listed, F.struct(F.col(quote(col)).alias("c")))
    sums = df.select(quote(key), wanted.alias("_wanted"), amount.alias("_amount")).groupBy(quote(key), "_wanted").agg(F.sum("_amount").alias("_n"))
    # keys without a listed category stay, with an empty map
    entry = F.when(F.col("_wanted").isNotNull(), F.struct(F.coalesce(F.col("_wanted.c").cast("string"), F.lit("")).alias("k"), F.col("_wanted.c").isNull().alias("none"), "_n"))
    maps = sums.groupBy(quote(key)).agg(F.collect_list(entry).alias("_all"))
    plain = F.map_from_entries(F.transform(F.filter("_all", lambda e: ~e["none"]), lambda e: F.struct(e["k"], e["_n"])))
    null = F.get(F.filter("_all", lambda e: e["none"]), F.lit(0))["_n"] if None in names else None
    maps = maps.withColumn("_map", plain)
    cells = [
        F.coalesce(null if c is None else F.try_element_at("_map", F.lit(str(c))), F.lit(0)).alias(name) for c, name in names.items()
    ]
    return maps.select(quote(key), *cells)


def category_counts(df: DataFrame, key: str, col: str, names: Mapping) -> DataFrame:
    """Rows per key and declared category, in one shuffle and without dummies; many text categories go through a map."""
    if len(names) > CONDITIONALS and dict(df.dtypes)[col] == "string":
        return _by_map(df, key, col, F.lit(1).cast("long"), names)
    return df.groupBy(key).agg(*count_exprs(col, names))


def pivot_sum(
    df: DataFrame, key: str, col: str, measure: str, names: Mapping
) -> DataFrame:
    """Key by category table of summed ``measure``, 0 where a pair is absent.

    Conditional sums need one exchange; ``pivot`` would plan a first aggregate by
    key and category and a second one by key. That is better only for many categories, so they go through a map.
    """
    if len(names) > CONDITIONALS and dict(df.dtypes)[col] == "string":
        return _by_map(df, key, col, F.col(quote(measure)), names)
    cells = [
        F.coalesce(F.sum(F.when(matches(col, c), F.col(measure))), F.lit(0)).alias(name)
        for c, name in names.items()
    ]
    return df.groupBy(key).agg(*cells)
