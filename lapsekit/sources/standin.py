"""The test tables seen as subscriptions, complaints, customers, delivery, formula.

Orders play subscriptions and their lines play deliveries; text measures carry
the ``NA`` sentinel of the real files so that the typing steps have work to do.
Money is summed as whole cents, which is exact in any order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.sources.readers import read_parquet

SENTINEL = "NA"


def _decimal_text(whole: Column, unit: str, places: int = 2) -> Column:
    """``whole`` units of 10^-n as text with so many decimals."""
    scaled = whole.cast("decimal(20,0)") * F.lit(unit).cast("decimal(5,4)")
    return scaled.cast(f"decimal(18,{places})").cast("string")


def _or_sentinel(text: Column) -> Column:
    return F.coalesce(text, F.lit(SENTINEL))


def _per_order(spark: SparkSession, folder: str) -> DataFrame:
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    percent = F.rint(F.col("l_discount") * 100).cast("int")
    lines = read_parquet(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_partkey",
        F.col("l_quantity").cast("bigint").alias("quantity"),
        cents.alias("cents"),
        percent.alias("percent"),
        F.rint(F.col("l_tax") * 100).cast("int").alias("tax"),
        F.col("l_returnflag").alias("flag"),
    )
    return lines.groupBy("o_orderkey").agg(
        F.min("l_partkey").alias("FormulaID"),
        F.sum("quantity").alias("quantity"),
        F.sum("cents").alias("gross"),
        F.sum(F.col("cents") * (100 - F.col("percent"))).alias("net"),
        F.min(F.col("cents") * (100 - F.col("percent"))).alias("cheapest"),
        F.min("percent").alias("least_off"),
        F.max("percent").alias("most_off"),
        F.max("tax").alias("tax"),
        F.sum(F.when(F.col("flag") == "R", F.col("cents")).otherwise(0)).alias("returned"),
    )


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders")
    joined = orders.join(_per_order(spark, folder), ["o_orderkey"], "left")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    price = _decimal_text(F.rint(F.col("o_totalprice") * 100).cast("bigint"), "0.01")
    status = F.col("o_orderstatus")
    start = F.to_date("o_orderdate")
    return joined.select(
        F.col("o_custkey").alias("CustomerID"),
        F.col("o_orderkey").alias("SubscriptionID"),
        start.alias("StartDate"),
        F.when(F.col("gross").isNotNull(), F.date_add(start, 30)).alias("EndDate"),
        F.when(status == "P", SENTINEL).otherwise(day).alias("RenewalDate"),
        F.when(status == "O", SENTINEL).otherwise(day).alias("PaymentDate"),
        "FormulaID",
        F.col("o_orderpriority").alias("ProductName"),
        _or_sentinel(F.col("quantity").cast("string")).alias("NbrMeals_REG"),
        F.when(status == "O", SENTINEL).otherwise(price).alias("NbrMeals_EXCEP"),
        _or_sentinel(_decimal_text(F.col("gross"), "0.01")).alias("GrossFormulaPrice"),
        _or_sentinel(_decimal_text(F.col("net"), "0.0001")).alias("NetFormulaPrice"),
        _or_sentinel(_decimal_text(F.col("cheapest"), "0.0001", 4)).alias("NbrMealsPrice"),
        _or_sentinel(F.col("least_off").cast("string")).alias("ProductDiscount"),
        _or_sentinel(F.col("tax").cast("string")).alias("FormulaDiscount"),
        _or_sentinel(F.col("most_off").cast("string")).alias("TotalDiscount"),
        price.alias("TotalPrice"),
        _or_sentinel(_decimal_text(F.col("returned"), "0.01")).alias("TotalCredit"),
    )


def owners(spark: SparkSession, folder: str) -> DataFrame:
    """Which customer a subscription belongs to, without touching the lines."""
    return read_parquet(spark, folder, "orders").select(
        F.col("o_orderkey").alias("SubscriptionID"), F.col("o_custkey").alias("CustomerID")
    )


def complaints(spark: SparkSession, folder: str) -> DataFrame:
    # parsed in a step of its own: as part of the conditions below it would be parsed again for each of them
    events = read_parquet(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, value = F.col("k"), F.col("value")
    return events.select(
        F.col("event_id").alias("ComplaintID"),
        F.col("user_id").alias("CustomerID"),
        F.to_date("ts").alias("ComplaintDate"),
        F.when(k % 5 == 0, "basic")
        .when(k % 5 == 1, "plus")
        .when(k % 5 == 2, "family")
        .when(k % 5 == 3, "event")
        .otherwise(SENTINEL)
        .alias("ProductName"),
        F.when(k % 20 == 7, SENTINEL)
        .when(F.col("event_type") == "error", "other")
        .when(F.col("event_type") == "signup", "sign.up")
        .otherwise(F.col("event_type"))
        .alias("ComplaintTypeDesc"),
        F.when(k < 25, "discount")
        .when(k < 50, "free service")
        .when(k < 70, "no compensation")
        .when(k < 85, "other")
        .otherwise(SENTINEL)
        .alias("SolutionTypeDesc"),
        F.when(value < 10, "satisfied")
        .when(value < 30, "not satisfied")
        .when(value < 60, "no response")
        .when(value < 100, "other")
        .otherwise(SENTINEL)
        .alias("FeedbackTypeDesc"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    nation = read_parquet(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("Region")
    )
    customer = read_parquet(spark, folder, "customer")
    return customer.join(nation, ["c_nationkey"], "left").select(F.col("c_custkey").alias("CustomerID"), "Region")


def delivery(spark: SparkSession, folder: str, with_id: bool = False) -> DataFrame:
    flag = F.col("l_returnflag")
    number = [(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("DeliveryID")] if with_id else []
    return read_parquet(spark, folder, "lineitem").select(
        *number,
        F.col("l_orderkey").alias("SubscriptionID"),
        F.col("l_linestatus").alias("DeliveryClass"),
        F.when(flag != "N", flag).alias("DeliveryTypeName"),
        F.to_date("l_shipdate").alias("DeliveryDate"),
    )


def formula(spark: SparkSession, folder: str) -> DataFrame:
    return read_parquet(spark, folder, "part").select(
        F.col("p_partkey").alias("FormulaID"), F.col("p_type").alias("FormulaType")
    )


def sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "subscriptions": subscriptions(spark, folder),
        "owners": owners(spark, folder),
        "complaints": complaints(spark, folder),
        "customers": customers(spark, folder),
        "delivery": delivery(spark, folder),
        "formula": formula(spark, folder),
    }
