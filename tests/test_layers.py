import datetime as dt
from decimal import Decimal

from conftest import rows_of

from strata.plans import layers as op

D = dt.date


def test_months_without_a_predecessor_have_no_change(make):
    daily = make([(D(2024, 1, 3), Decimal(5)), (D(2024, 1, 9), Decimal(2)), (D(2024, 2, 1), Decimal(10)), (D(2024, 4, 1), Decimal(1)),
                  (D(2024, 5, 1), None)], "dt date, amount decimal(10,2)")
    assert rows_of(op.ads_sales_report(daily), "month", "amount", "previous_amount", "change") == [
        (D(2024, 1, 1), Decimal(7), None, None), (D(2024, 2, 1), Decimal(10), Decimal(7), Decimal(3)),
        (D(2024, 4, 1), Decimal(1), None, None), (D(2024, 5, 1), None, Decimal(1), None)]


def test_retention(make):
    t = lambda day: dt.datetime(2024, 1, day, 12)
    events = make([(1, t(1)), (1, t(1)), (1, t(2)), (2, t(1)), (2, t(8)), (3, t(2)), (3, t(3)), (None, t(1))], "user_id int, ts timestamp_ntz")
    assert rows_of(op.ads_user_retention(events, [1, 7])) == [
        (D(2024, 1, 1), 2, 1, 1, 0.5), (D(2024, 1, 1), 2, 7, 1, 0.5), (D(2024, 1, 2), 1, 1, 1, 1.0), (D(2024, 1, 2), 1, 7, 0, 0.0)]


def test_active_users_exact_and_approximate(make):
    events = make([(i % 4, dt.datetime(2024, 1, 1 + i % 2)) for i in range(40)], "user_id int, ts timestamp_ntz")
    exact = rows_of(op.dws_user_active(events))
    assert exact == [(D(2024, 1, 1), 2), (D(2024, 1, 2), 2)] and rows_of(op.dws_user_active(events, approx=True)) == exact


def test_shares(make):
    sales = make([("a", 1.0), ("b", 1.0), ("c", 1.0), ("a", 0.0)], "k string, v double")
    assert rows_of(op.share_of_total(sales, "k", "v", 2), "k", "share") == [("a", 33.3), ("b", 33.3), ("c", 33.3)]


def test_profile_keeps_customers_without_orders(make):
    customer = make([(1, 7), (2, 99)], "c_custkey int, c_nationkey int")
    orders = make([(1, 2.5, dt.datetime(2024, 1, 1)), (1, 0.1, dt.datetime(2024, 2, 1))], "o_custkey int, o_totalprice double, o_orderdate timestamp_ntz")
    nation, region = make([(7, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"), make([(1, "R")], "r_regionkey int, r_name string")
    assert rows_of(op.dwd_user_profile(customer, orders, nation, region)) == [
        (1, "N", "R", 2, Decimal("2.60"), D(2024, 1, 1), D(2024, 2, 1)), (2, None, None, 0, Decimal("0.00"), None, None)]


def test_two_series_keep_unmatched_days(make):
    a, b = make([(D(2024, 1, 1), 1)], "dt date, x int"), make([(D(2024, 1, 2), 2)], "dt date, y int")
    assert rows_of(op.sales_and_activity(a, b)) == [(D(2024, 1, 1), 1, None), (D(2024, 1, 2), None, 2)]


def test_etl_insert_appends(spark, make, tmp_path):
    rows = make([(1,), (2,)], "a int")
    for _ in range(2):
        op.insert_select(spark, "SELECT a * 10 AS a FROM {rows}", "etl_check.t", path=str(tmp_path / "t"), rows=rows)
    assert rows_of(spark.table("etl_check.t")) == [(10,), (10,), (20,), (20,)]
