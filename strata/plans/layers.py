"""Layer tables: detail, summary and application tables over raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.functions.money import exact_sum, units
from strata.sources.tables import write_table

# Days after the first active day at which retention is measured.
RETENTION_DAYS = (1, 7, 14)

# Decimal digits of a price, of a discount, and of the amount of a line.
PRICE_DIGITS = 2
DISCOUNT_DIGITS = 2
AMOUNT_DIGITS = PRICE_DIGITS + DISCOUNT_DIGITS


def line_amount() -> Column:
    """Discounted price of a line: the product of whole cents and whole percent, without rounding error."""
    percent = 10**DISCOUNT_DIGITS - units("l_discount", DISCOUNT_DIGITS)
    return units("l_extendedprice", PRICE_DIGITS) * percent / F.lit(10.0**AMOUNT_DIGITS)


def insert_select(spark: SparkSession, sql: str, target: str, mode: str = "append", path: str | None = None,
                  **tables: DataFrame) -> DataFrame:
    """An ETL task: the rows of one query go into a warehouse table."""
    return write_table(spark.sql(sql, **tables), target, mode=mode, path=path)


def dwd_order_detail(orders: DataFrame, lineitem: DataFrame, customer: DataFrame, part: DataFrame) -> DataFrame:
    """One row per order line with its order, customer segment and part type.

    Customers meet orders, not lines, so the widest table is never shuffled by customer. The join by
    order comes last and leaves the rows placed by order, which the daily distinct count can use. No
    broadcast is forced: the planner broadcasts a dimension while it is under its size limit and joins
    by key beyond it.
    """
    headers = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", "o_custkey", "o_orderdate", "c_mktsegment")
    return (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"),
            F.col("o_custkey").alias("customer_key"), F.col("c_mktsegment").alias("segment"),
            F.col("l_partkey").alias("part_key"), F.col("p_type").alias("part_type"),
            F.to_date("o_orderdate").alias("dt"), F.col("l_quantity").alias("quantity"),
            line_amount().alias("amount")))


def dwd_user_profile(customer: DataFrame, orders: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """One row per customer with place and order history; customers without orders stay."""
    history = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("order_count"), exact_sum("o_totalprice", PRICE_DIGITS).alias("total"),
        F.min(F.to_date("o_orderdate")).alias("first_order"), F.max(F.to_date("o_orderdate")).alias("last_order"))
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return (
        customer.join(places, customer.c_nationkey == places.n_nationkey, "left")
        .join(history, customer.c_custkey == history.o_custkey, "left")
        .select(
            F.col("c_custkey").alias("customer_key"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
            F.coalesce("order_count", F.lit(0).cast("bigint")).alias("order_count"),
            F.coalesce("total", F.lit(0).cast("decimal(38,2)")).alias("total"), "first_order", "last_order"))


def dws_daily_sales(detail: DataFrame) -> DataFrame:
    """Orders, lines and amount per day."""
    return detail.groupBy("dt").agg(
        F.count_distinct("order_key").alias("orders"), F.count(F.lit(1)).alias("lines"),
        exact_sum("amount", AMOUNT_DIGITS).alias("amount"))


def dws_user_active(events: DataFrame, user: str = "user_id", time: str = "ts", approx: bool = False) -> DataFrame:
    """Active users per day; ``approx`` trades exactness for one pass without a distinct shuffle."""
    users = F.approx_count_distinct(user) if approx else F.count_distinct(user)
    return events.groupBy(F.to_date(time).alias("dt")).agg(users.alias("active_users"))


def ads_sales_report(daily: DataFrame) -> DataFrame:
    """Amount per month against the calendar month before.

    Each month's amount also goes to the next month as its previous amount, and the two meet in one
    aggregate: the days are computed once, and no window runs over all months.
    """
    monthly = daily.groupBy(F.trunc("dt", "month").alias("month")).agg(F.sum("amount").alias("amount"))
    nothing = F.lit(None).cast(monthly.schema["amount"].dataType)
    own = F.struct("month", "amount", nothing.alias("previous_amount"), F.lit(True).alias("own"))
    as_previous = F.struct(F.add_months("month", 1).alias("month"), nothing.alias("amount"),
                           F.col("amount").alias("previous_amount"), F.lit(False).alias("own"))
    met = monthly.select(F.inline(F.array(own, as_previous))).groupBy("month").agg(
        F.max("amount").alias("amount"), F.max("previous_amount").alias("previous_amount"), F.max("own").alias("own"))
    return met.where("own").select(
        "month", "amount", "previous_amount", (F.col("amount") - F.col("previous_amount")).alias("change"))


def ads_user_retention(events: DataFrame, days: Sequence[int] = RETENTION_DAYS, user: str = "user_id",
                       time: str = "ts") -> DataFrame:
    """Share of each first-day cohort that is active again some days later.

    Events are read once and shrink to one row per user and day. The first day is then a window minimum
    over at most as many rows per user as there are days, and counting needs no second distinct.
    """
    active = events.where(F.col(user).isNotNull()).select(user, F.to_date(time).alias("day")).distinct()
    first = active.withColumn("cohort", F.min("day").over(W.partitionBy(user)))
    age = F.date_diff("day", "cohort")
    cohorts = first.groupBy("cohort").agg(
        F.count_if(age == 0).alias("cohort_size"), *[F.count_if(age == day).alias(f"d{day}") for day in days])
    offsets = F.array(*[F.struct(F.lit(day).alias("day_offset"), F.col(f"d{day}").alias("retained")) for day in days])
    return cohorts.select("cohort", "cohort_size", F.inline(offsets)).withColumn(
        "rate", F.col("retained").cast("double") / F.col("cohort_size"))


def share_of_total(df: DataFrame, category: str, value: str, digits: int = AMOUNT_DIGITS) -> DataFrame:
    """Percent of the total per category, to one decimal.

    The total is one value from the grouped rows, not a window that brings all categories together. It is a part of
    the plan, whose aggregate by category serves both, so nothing runs before the result is asked for.
    """
    grouped = df.groupBy(category).agg(exact_sum(value, digits).alias("value"))
    total = grouped.agg(F.sum("value").cast("double")).scalar()
    share = F.floor(F.col("value").cast("double") * 1000 / total + F.lit(0.5)) / F.lit(10.0)
    return grouped.select(category, "value", share.alias("share"))


def sales_and_activity(left: DataFrame, right: DataFrame, on: str = "dt") -> DataFrame:
    """Two series on one time axis; a step that only one series has stays."""
    return left.join(right, on, "full_outer")
