"""Layer tables over the given tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import activity
from strata.plans import layers as op
from strata.plans.registry import ORACLES, Data, register
from strata.session import fresh_path
from strata.streaming import ingest
from strata.streaming.materialize import materialize, materialize_stream, windowed_counts, with_open_windows

DETAIL = """
    detail AS (
      SELECT l_orderkey AS order_key, l_linenumber AS line_number, o_custkey AS customer_key, c_mktsegment AS segment,
             l_partkey AS part_key, p_type AS part_type, CAST(o_orderdate AS DATE) AS dt, l_quantity AS quantity,
             CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(24,4)) AS amount
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN part ON l_partkey = p_partkey)"""
DAILY = DETAIL + """,
    daily AS (SELECT dt, count(DISTINCT order_key) AS orders, count(*) AS lines, sum(amount) AS amount FROM detail GROUP BY dt)"""


def _detail(d: Data):
    return op.dwd_order_detail(*[d.table(name) for name in ("orders", "lineitem", "customer", "part")])


def _daily(d: Data):
    return op.dws_daily_sales(_detail(d))


def _money(df, *names):
    """Exact sums as doubles, for comparison with the twin."""
    return df.withColumns({name: F.col(name).cast("double") for name in names})


@register("WITH" + DAILY + " SELECT dt, CAST(amount AS DOUBLE) AS amount FROM daily")
def insert_select(d: Data):
    table = op.insert_select(
        d.spark, "SELECT dt, sum(CAST(amount AS DECIMAL(18,4))) AS amount FROM {detail} GROUP BY dt", "strata_check.daily_amount", "overwrite",
        fresh_path(d.spark, "daily"), detail=_detail(d))
    return _money(table, "amount")


@register("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS rows FROM events GROUP BY 1")
def materialize_full(d: Data):
    return materialize(d.spark, lambda: windowed_counts(d.table("events"), "ts"), fresh_path(d.spark, "counts"))


@register("""
    SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS rows FROM events GROUP BY 1
    HAVING date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def materialize_windows(d: Data):
    """Windows closed by the watermark of one run over all events."""
    base = fresh_path(d.spark, "windows")
    stream = ingest.stream_files(d.spark, d.folder, d.table("events").schema, "events.parquet")
    ingest.run_to_end(materialize_stream(
        stream, windowed_counts, "ts", "1 hour", f"{base}/table", f"{base}/checkpoint", once=True))
    return d.spark.read.parquet(f"{base}/table")


@register("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS rows FROM events GROUP BY 1")
def materialize_all_windows(d: Data):
    """Closed windows of a stream and the open ones from the rows after them: every day."""
    return with_open_windows(materialize_windows(d), d.table("events"), windowed_counts, "ts")


@register("WITH" + DETAIL + " SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM detail")
def dwd_order_detail(d: Data):
    return _detail(d)


@register("""
    SELECT c_custkey AS customer_key, n_name AS nation, r_name AS region, count(o_orderkey) AS order_count,
           CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total,
           CAST(min(o_orderdate) AS DATE) AS first_order, CAST(max(o_orderdate) AS DATE) AS last_order
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
         LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY 1, 2, 3""")
def dwd_user_profile(d: Data):
    return _money(op.dwd_user_profile(*[d.table(name) for name in ("customer", "orders", "nation", "region")]), "total")


@register("WITH" + DAILY + " SELECT dt, orders, lines, CAST(amount AS DOUBLE) AS amount FROM daily")
def dws_daily_sales(d: Data):
    return _money(_daily(d), "amount")


@register("SELECT CAST(ts AS DATE) AS dt, count(DISTINCT user_id) AS active_users FROM events GROUP BY 1")
def dws_user_active(d: Data):
    return op.dws_user_active(d.table("events"))


@register("WITH" + DAILY + """,
    monthly AS (SELECT CAST(date_trunc('month', dt) AS DATE) AS month, sum(amount) AS amount FROM daily GROUP BY 1)
    SELECT m.month, CAST(m.amount AS DOUBLE) AS amount, CAST(p.amount AS DOUBLE) AS previous_amount,
           CAST(m.amount - p.amount AS DOUBLE) AS change
    FROM monthly m LEFT JOIN monthly p ON p.month = CAST(m.month - INTERVAL 1 MONTH AS DATE)""")
def ads_sales_report(d: Data):
    return _money(op.ads_sales_report(_daily(d)), "amount", "previous_amount", "change")


@register("""
    WITH active AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
         cohorts AS (SELECT user_id, min(day) AS cohort FROM active GROUP BY user_id),
         sizes AS (SELECT cohort, count(*) AS cohort_size FROM cohorts GROUP BY cohort),
         offsets AS (SELECT CAST(unnest([1, 7, 14]) AS INTEGER) AS day_offset)
    SELECT s.cohort, s.cohort_size, o.day_offset, count(a.user_id) AS retained,
           CAST(count(a.user_id) AS DOUBLE) / s.cohort_size AS rate
    FROM sizes s CROSS JOIN offsets o
         LEFT JOIN (SELECT a.user_id, c.cohort, a.day FROM active a JOIN cohorts c USING (user_id)) a
           ON a.cohort = s.cohort AND a.day = s.cohort + o.day_offset
    GROUP BY 1, 2, 3""")
def ads_user_retention(d: Data):
    return op.ads_user_retention(d.table("events"))


ACTIVE_IN = "SELECT CAST(date_trunc('{unit}', ts) AS DATE) AS start, count(DISTINCT user_id) AS active_users FROM events GROUP BY 1"


def _kept_activity(d: Data):
    """Bitmaps kept over three deliveries, the last of which adds to days that are there already."""
    path, events = fresh_path(d.spark, "activity"), d.table("events")
    for number in range(3):
        share = F.when(F.col("event_id") % 5 == 0, 2).when(F.col("ts") < "2024-01-10 00:00:00", 0).otherwise(1)
        activity.add_activity(path, events.where(share == number))
    return activity.read_activity(d.spark, path)


@register(" UNION ALL ".join(f"SELECT '{unit}' AS unit, * FROM ({ACTIVE_IN.format(unit=unit)})" for unit in ("day", "week", "month")))
def active_users(d: Data):
    kept = _kept_activity(d)
    return reduce(DataFrame.unionByName, [
        activity.active_users(kept, unit).select(F.lit(unit).alias("unit"), "*") for unit in ("day", "week", "month")])


@register(ORACLES["ads_user_retention"])
def retention(d: Data):
    """Retention from the kept bitmaps equals that from all events."""
    return activity.retention(_kept_activity(d))


@register("WITH" + DETAIL + """,
    grouped AS (SELECT part_type, sum(amount) AS value FROM detail GROUP BY part_type)
    SELECT part_type, CAST(value AS DOUBLE) AS value,
           floor(CAST(value AS DOUBLE) * 1000 / (SELECT CAST(sum(value) AS DOUBLE) FROM grouped) + 0.5) / 10 AS share
    FROM grouped""")
def share_of_total(d: Data):
    return _money(op.share_of_total(_detail(d), "part_type", "amount"), "value")


@register("""
    SELECT coalesce(o.dt, l.dt) AS dt, o.orders, l.lines
    FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, count(*) AS orders FROM orders GROUP BY 1) o
         FULL JOIN (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, count(*) AS lines FROM lineitem GROUP BY 1) l
         ON o.dt = l.dt""")
def sales_and_activity(d: Data):
    month = lambda column: F.trunc(F.to_date(column), "month").alias("dt")
    orders = d.table("orders").groupBy(month("o_orderdate")).agg(F.count(F.lit(1)).alias("orders"))
    lines = d.table("lineitem").groupBy(month("l_shipdate")).agg(F.count(F.lit(1)).alias("lines"))
    return op.sales_and_activity(orders, lines)
