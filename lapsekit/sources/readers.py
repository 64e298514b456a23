"""Reading tables, naming them for SQL, and looking at them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsekit.sources.schemas import SCHEMAS


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    null_value: str | None = None,
    date_format: str | None = None,
) -> DataFrame:
    """CSV with a header row, columns found by name.

    The file's header is read first (one line, no scan of the data), so the order
    of columns in the file does not matter and columns not in ``schema`` are text
    that gets pruned. Without a schema Spark infers one by scanning the file.
    """
    reader = spark.read.option("header", True)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    if date_format is not None:
        reader = reader.option("dateFormat", date_format)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    header = _header(spark, path)
    missing = [f.name for f in schema if f.name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    known = {f.name: f.dataType for f in schema}
    full = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
    return reader.option("enforceSchema", False).schema(full).csv(path).select(*schema.names)


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_sources(spark: SparkSession, paths: Mapping[str, str], **options) -> dict[str, DataFrame]:
    """The five source tables from CSV files, under their declared schemas."""
    unknown = set(paths) - set(SCHEMAS)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    return {name: read_csv(spark, path, SCHEMAS[name], **options) for name, path in paths.items()}


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def name_view(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` queryable by ``spark.sql`` as ``name``."""
    df.createOrReplaceTempView(name)
    return df


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows, as a frame; the caller decides how to show them."""
    return df.limit(rows)


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
