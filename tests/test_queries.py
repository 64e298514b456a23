"""Every named query against its SQL twin; model reports by their invariants."""

import pytest

import __spark_entry__ as contract
from oracle import differences, duck

# the queries over training corpora have their own tests
QUERIES = {name: fn for name, fn in contract.queries().items() if fn.__module__.startswith("lapsekit.plans")}
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_rows_as_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert differences(df, con, ORACLES[name]) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_rows_only_queries_give_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_is_the_feature_table(spark):
    df = contract.entry(spark)
    assert df.count() == df.select("CustomerID").distinct().count() > 0


@pytest.mark.parametrize("scale, positives", [("0.001", 19), ("0.01", 189), ("0.1", 1864)])
def test_label_counts(spark, scale, positives):
    rows = QUERIES["label_distribution"](spark, f"/root/testdata/sf{scale}").collect()
    assert {r["label"]: r["count"] for r in rows}[1] == positives


def test_scans_read_only_the_columns_they_need(spark, small):
    plan = QUERIES["delivery_block"](spark, small)._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line]
    assert len(schemas) == 2
    assert any(s.count(":") == 4 and "l_shipdate" in s for s in schemas)
    assert any(s == "struct<o_orderkey:bigint,o_custkey:bigint>" for s in schemas)
    assert "IsNotNull(o_custkey)" in plan and "IsNotNull(l_orderkey)" in plan
