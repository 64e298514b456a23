from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lapsekit.operators import aggregates as agg
from lapsekit.operators import encode
from lapsekit.operators.columns import fill_numeric, numeric_columns, rename, text_columns, union_all
from lapsekit.operators.joins import attach, fits_broadcast, gathered, hot_keys, left_star, one_row_per_key, salted_join
from lapsekit.operators.latest import dedup_key, latest_flag, latest_per_key, unpack_flag
from lapsekit.plans import blocks
from lapsekit.plans.specs import STANDIN
from lapsekit.sources import standin


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def exchanges(df):
    """Shuffles of a plan that has not run yet (a finished one lists them twice)."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def periods(spark):
    data = [
        (1, 10, date(2018, 1, 1), "a"),
        (1, 11, date(2018, 1, 1), "b"),
        (1, 12, None, "c"),
        (2, 20, None, "d"),
        (2, 21, None, "e"),
        (3, 30, date(2017, 1, 1), None),
    ]
    return spark.createDataFrame(data, "k int, id int, day date, v string")


def test_latest_breaks_ties_and_nulls_undated_keys(periods):
    got = rows(latest_per_key(periods, "k", ("day", "id"), ("id", "v")))
    assert got == [(1, 11, "b"), (2, None, None), (3, 30, None)]


def test_latest_is_one_shuffle_whatever_the_partitioning(periods):
    for n in (1, 3, 7):
        df = latest_per_key(periods.repartition(n), "k", ("day", "id"), ("id", "v"))
        assert rows(df) == [(1, 11, "b"), (2, None, None), (3, 30, None)]
    assert exchanges(latest_per_key(periods, "k", ("day", "id"), ("id", "v"))) == 1


def test_dedup_keeps_whole_rows(periods):
    got = rows(dedup_key(periods, "k", ("day", "id")))
    assert got == [(1, 11, date(2018, 1, 1), "b"), (2, 21, None, "e"), (3, 30, date(2017, 1, 1), None)]


def test_dedup_of_an_empty_table(periods):
    assert dedup_key(periods.where("k > 99"), "k", ("day",)).count() == 0


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under key 7, a few under NULL."""
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50).alias("k")
    )


def test_hot_keys_finds_the_heavy_key(skewed):
    assert hot_keys(skewed, "k", 0.1) == [7]
    assert hot_keys(skewed.where("k is null"), "k") == []
    assert hot_keys(skewed.where("id < 0"), "k") == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(0, 40)] + [(7, "again")], "k bigint, n string")
    plain = skewed.join(dim, ["k"], how).select("k", "id", "n")
    salted = salted_join(skewed, dim, "k", [7], ["id"], how).select("k", "id", "n")
    assert rows(salted) == rows(plain)
    by_size = attach(skewed, dim, "k", ["id"], how, broadcast_rows=10).select("k", "id", "n")
    assert rows(by_size) == rows(plain)


def test_attach_broadcasts_only_a_proven_small_side(spark, skewed):
    dim = spark.createDataFrame([(k, k) for k in range(40)], "k bigint, n int")
    assert fits_broadcast(dim, 40) and not fits_broadcast(dim, 39) and not fits_broadcast(dim, 40, 100)
    wide = spark.createDataFrame([(1, "x" * 5000)], "k bigint, n string")
    assert not fits_broadcast(wide, 40, 4000) and fits_broadcast(wide, 40, 6000)
    salted = attach(skewed, dim, "k", ["id"], broadcast_rows=39)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    small = attach(skewed, dim, "k", ["id"], broadcast_rows=40)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_the_search_for_hot_keys_and_the_join_read_written_rows(spark, skewed):
    dim = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("n"))
    costly = skewed.where(F.sha1(F.col("id").cast("string")) != "")
    joined = attach(costly, dim, "k", ["id"], broadcast_rows=39, write_fact=True)
    assert "sha1" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert rows(joined.select("k", "id", "n")) == rows(skewed.join(dim, ["k"], "left").select("k", "id", "n"))


def test_gathered_rows_need_no_map_side_buffers(spark):
    """One exchange of plain rows; a hot key is spread, and its few buffers cross a second one."""
    even = spark.range(0, 4000, 1, 4).select((F.col("id") % 2000).alias("k"), "id")
    summed = gathered(even, "k", ["id"]).groupBy("k").agg(F.sum("id").alias("s"))
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert exchanges(summed) == 1 and plan.index("partial_sum") < plan.index("Exchange")
    assert rows(summed) == rows(even.groupBy("k").agg(F.sum("id").alias("s")))
    hot = even.withColumn("k", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 != 1, F.col("k")))
    dealt = gathered(hot, "k", ["id"])
    summed = dealt.groupBy("k").agg(F.sum("id").alias("s"))
    assert exchanges(summed) == 2 and rows(summed) == rows(hot.groupBy("k").agg(F.sum("id").alias("s")))
    assert "RepartitionByExpression [k" in (plan := dealt._jdf.queryExecution().optimizedPlan().toString()) and "_salt" in plan


def test_subscriptions_cross_one_exchange_as_rows(spark):
    block = blocks.subscription_block(standin.subscriptions(spark, "/root/testdata/sf0.01"), STANDIN)
    plan = block._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(CustomerID" in line]
    assert len(dealt) == 1 and "REPARTITION_BY_COL" in dealt[0]


def test_props_are_parsed_in_a_step_of_their_own(spark, small):
    plan = standin.complaints(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1


def test_alike_rows_of_a_hot_key_are_spread(spark):
    fact = spark.range(10_000).select("id", F.lit(7).alias("k"), F.lit("same").alias("v"))
    dim = spark.createDataFrame([(7, "n")], "k int, n string")
    spread = salted_join(fact, dim, "k", [7], ["id"]).drop("_salt")
    assert spread.count() == 10_000
    salts = fact.select(F.pmod(F.xxhash64("id"), F.lit(64)).alias("s")).groupBy("s").count().collect()
    assert len(salts) == 64 and max(r["count"] for r in salts) < 400


@pytest.mark.parametrize("how", ["right", "full", "left_anti"])
def test_only_left_and_inner_joins_are_salted(spark, skewed, how):
    with pytest.raises(ValueError):
        attach(skewed, skewed, "k", ["id"], how)


def test_sizing_reads_no_rows_into_one_task(spark, skewed):
    plan = skewed.agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "LocalLimit" not in plan and "partial_count" in plan


def test_latest_flag_needs_no_sort(spark):
    rows_in = [
        (1, datetime(2018, 5, 1, 10), 1, "NA"), (1, datetime(2018, 5, 1, 11), 0, "x"),
        (2, datetime(1960, 1, 1), -(2**63), "x"), (2, datetime(1960, 1, 1), 2**63 - 1, "NA"),
        (3, None, 5, "NA"), (4, datetime(9999, 12, 31, 23, 59, 59, 999999), None, None), (4, datetime(1, 1, 1), 3, "NA"),
    ]
    df = spark.createDataFrame(rows_in, "k int, d timestamp_ntz, i bigint, t string")
    best = df.groupBy("k").agg(latest_flag("d", "i", F.col("t") == "NA").alias("p"))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    year, flag = unpack_flag("p")
    assert rows(best.select("k", year, flag)) == [(1, 2018, 0), (2, 1960, 1), (3, None, None), (4, 9999, 0)]


def test_repeated_dimension_key_fails_the_job(spark):
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, n string")
    with pytest.raises(Exception, match="more than one row for k 1"):
        one_row_per_key(dim, "k", ["n"]).count()
    single = one_row_per_key(dim.where("n <> 'b'"), "k", ["n"])
    assert rows(single) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception, match="more than one row"):
        left_star(spark.range(3).withColumnRenamed("id", "k"), [one_row_per_key(dim, "k", ["n"])], "k").collect()


def test_categories(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "a")], "k int, c string")
    assert encode.discover_categories(df, "c") == ["a", "b"]
    with pytest.raises(ValueError):
        encode.discover_categories(df, "c", limit=1)
    assert rows(encode.one_hot(df, "c", ["a", None]).drop("c")) == [(1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 1, 0)]
    assert encode.one_hot(df, "c").columns == ["k", "c", "c_a", "c_b"]


def test_same_text_in_two_columns_stays_apart(spark):
    df = spark.createDataFrame([(1, "other", "other")], "k int, a string, b string")
    both = encode.one_hot(encode.one_hot(df, "a", ["other"]), "b", ["other"])
    assert rows(agg.sum_numeric(both, "k")) == [(1, 1, 1)]


def test_counts_agree_with_summed_dummies_and_use_one_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.concat(F.lit("c"), (F.col("id") % 3)).alias("c"))
    counted = encode.category_counts(df, "k", "c", {"c0": "n0", "c1": "n1"})
    summed = agg.sum_numeric(encode.one_hot(df, "c", ["c0", "c1"]), "k")
    assert exchanges(counted) == 1
    assert rows(counted) == rows(summed)


def test_pivot_fills_absent_cells_and_years(spark):
    df = spark.createDataFrame([(1, 2014, 2), (1, 2014, 3), (2, None, 4)], "k int, y int, n int")
    got = encode.pivot_sum(df, "k", "y", "n", {2014: "y14", 2020: "y20", None: "null"})
    assert rows(got) == [(1, 5, 0, 0), (2, 0, 0, 4)] and got.columns == ["k", "y14", "y20", "null"]


def test_yearly_frequency_totals_declared_years_only(spark):
    df = spark.createDataFrame([(1, date(2014, 1, 1)), (1, date(2013, 1, 1)), (1, None)], "k int, d date")
    assert rows(agg.yearly_frequency(df, "k", "d", [2014, 2015], "Sub_", "n")) == [(1, 1, 0, 1)]


def test_profile_of_an_all_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, 1.005), (2, 1.01)], "k int, m double")
    got = rows(agg.measure_profile(df, "k", ["m"], counted=["m"], exact_scale={"m": 3}))
    assert got == [(1, None, None, None, 0), (2, 1.01, 1.01, 1.01, 2)]


@pytest.mark.parametrize("values, mean", [((1.004, 1.004, 1.014), 1.01), ((1e18, 2.0), 5e17), ((1.12345678901, 1.0), 1.06), ((None, 2.0), 2.0)])
def test_no_value_is_cut_before_it_is_averaged(spark, values, mean):
    df = spark.createDataFrame([(1, v) for v in values], "k int, m double")
    assert agg.measure_profile(df, "k", ["m"], exact_scale={"m": 10}).first()["avg_m"] == mean


def test_exact_mean_does_not_depend_on_row_order(spark):
    df = spark.range(2000).select(F.lit(1).alias("k"), F.round(F.col("id") * 0.01 + 0.1, 2).alias("m"))
    means = {agg.measure_profile(df.repartition(n), "k", ["m"], exact_scale={"m": 2}).first()["avg_m"] for n in (1, 3, 8)}
    assert len(means) == 1


def test_tenure_sums_periods_and_span_does_not(spark):
    data = [(1, date(2018, 1, 1), date(2018, 1, 11), None), (1, date(2018, 2, 1), date(2018, 2, 11), date(2019, 3, 1))]
    df = spark.createDataFrame(data, "k int, s date, e date, p date")
    exprs = agg.tenure_exprs("s", "e", date(2019, 2, 1), {"p": "since"}, "sum", span="span")
    assert rows(df.groupBy("k").agg(*exprs)) == [(1, 20, -28, 41)]


def test_rename_fill_union_and_types(spark):
    df = spark.createDataFrame([(1, None, None)], "a int, b double, c string")
    with pytest.raises(ValueError):
        rename(df, {"zz": "y"})
    assert rename(df, {"a": "A"}).columns == ["A", "b", "c"]
    assert rows(fill_numeric(df)) == [(1, 0.0, None)]
    assert rows(fill_numeric(df, 0, {"b": -1.0})) == [(1, -1.0, None)]
    assert text_columns(df) == ["c"] and numeric_columns(df, ["a"]) == ["b"]
    x = spark.createDataFrame([(1, 2)], "a int, b int")
    y = spark.createDataFrame([(3, 4)], "b int, a int")
    assert rows(union_all(x, y)) == [(1, 2), (4, 3)]
    assert rows(union_all(x, y, positional=True)) == [(1, 2), (3, 4)]


def test_discovery_makes_no_row_for_each_value(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, None), (None, 1, None)], "x string, `y.z` int, w string")
    assert encode.discover_each(df, ["x", "y.z", "w"]) == {"x": ["a", "b"], "y.z": ["1", "2"], "w": []}
    many = spark.range(5000).select(F.col("id").alias("x"))
    for limit in (4999, 100):
        with pytest.raises(ValueError, match=f"x has more than {limit} categories"):
            encode.discover_each(many, ["x"], limit)
    assert len(encode.discover_each(many, ["x"], 5000)["x"]) == 5000


def test_many_categories_go_through_a_map(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 7).alias("k"), F.concat(F.lit("c"), F.col("id") % 30).alias("c"), F.col("id").alias("m"))
    df = df.withColumn("c", F.when(F.col("m") % 11 == 0, None).otherwise(F.col("c"))).unionAll(spark.createDataFrame([(99, "odd", 1)], df.schema))
    names = {None: "none", **{f"c{i}": f"n{i}" for i in range(40)}}
    want = [encode.pivot_sum(df, "k", "c", "m", names), encode.category_counts(df, "k", "c", names)]
    want = [(x.dtypes, rows(x)) for x in want]
    monkeypatch.setattr(encode, "CONDITIONALS", 5)
    got = [encode.pivot_sum(df, "k", "c", "m", names), encode.category_counts(df, "k", "c", names)]
    assert [(x.dtypes, rows(x)) for x in got] == want
