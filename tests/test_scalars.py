from datetime import date, datetime

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lapsekit import functions as L
from lapsekit.operators.columns import as_measures, convert


def one(df, column):
    return [r[0] for r in df.select(column.alias("x")).collect()]


@pytest.fixture
def texts(spark):
    rows = [("NA",), ("3.7",), ("",), (" 12 ",), (None,), ("-3.7",), ("99999999999",)]
    return spark.createDataFrame(rows, "x string").coalesce(1)


def test_text_to_integer_truncates_and_never_throws(texts):
    assert one(texts, L.to_integer("x")) == [None, 3, None, 12, None, -3, None]


def test_text_to_double(texts):
    assert one(texts, L.to_double("x"))[:5] == [None, 3.7, None, 12.0, None]


def test_measure_or_zero(texts):
    assert one(texts, L.measure_or_zero("x"))[:5] == [0.0, 3.7, 0.0, 12.0, 0.0]


def test_missing_measures_are_ignored_or_zero(spark):
    df = spark.createDataFrame([("NA",), ("10",), ("9",)], "raw string")
    typed = convert(df, {"raw": ("m", "int")})
    stats = lambda d: d.agg(F.avg("m"), F.min("m"), F.max("m"), F.count("m")).first()
    assert tuple(stats(as_measures(typed, ["m"]))) == (9.5, 9.0, 10.0, 2)
    assert tuple(stats(as_measures(typed, ["m"], "zero"))) == (19 / 3, 0.0, 10.0, 3)
    with pytest.raises(ValueError):
        as_measures(typed, ["m"], "other")


def test_dates(spark):
    df = spark.createDataFrame([("2018/12/31",), ("NA",), ("2018/13/01",), (None,)], "x string").coalesce(1)
    assert one(df, L.parse_date("x", "yyyy/MM/dd")) == [date(2018, 12, 31), None, None, None]
    iso = spark.createDataFrame([("2018-12-31",), ("NA",)], "x string").coalesce(1)
    assert one(iso, L.to_moment("x")) == [datetime(2018, 12, 31), None]
    assert one(iso, L.date_or("x", F.lit(date(2020, 1, 1)))) == [date(2018, 12, 31), date(2020, 1, 1)]


def test_days_between_may_be_negative(spark):
    df = spark.createDataFrame([(date(2019, 3, 1),)], "d date")
    assert one(df, L.days_between(F.lit(date(2019, 2, 1)), "d")) == [-28]


def test_label_truth_table(spark):
    rows = [("NA", 2018), ("NA", 2019), (None, 2018), ("NA", None), ("2018-05-01", 2018)]
    days = [(r, date(y, 6, 1) if y else None) for r, y in rows]
    df = spark.createDataFrame(days, "r string, e date").coalesce(1)
    assert one(df, L.churn_flag("r", "e", "NA", 2019)) == [1, 0, 0, 0, 0]


def test_recode_tag_and_row_sum(spark):
    df = spark.createDataFrame([("NA", 1, None), ("other", 2, 3), (None, None, None), ("x", 0, 0)], "c string, a int, b int")
    df = df.coalesce(1)
    assert one(df, L.recode("c", {"NA": "none", "other": "none"})) == ["none", "none", None, "x"]
    assert one(df, L.recode("c", {})) == ["NA", "other", None, "x"]
    assert one(df, L.tag("R", "a")) == ["R1", "R2", None, "R0"]
    assert one(df, L.row_sum(["a", "b"])) == [1, 5, 0, 0]


def test_positive_probability_is_float_without_python(spark):
    df = spark.createDataFrame([(Vectors.dense(0.25, 0.75),)], ["p"]).select(L.positive_probability("p").alias("x"))
    assert df.dtypes == [("x", "float")] and df.first()[0] == 0.75
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
