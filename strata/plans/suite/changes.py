"""Change capture over the event changelog, in batch and as streams."""

from pyspark.sql import functions as F

from strata.operators import changes as op
from strata.operators import retract, state
from strata.plans.registry import Data, register
from strata.session import fresh_path
from strata.streaming import ingest, metrics, tables

ROW = "id bigint, status string, amount double, event_time timestamp_ntz"
MIDDLE = "(SELECT max(event_id) // 2 FROM events)"
LAST = "SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"


def _middle(d: Data) -> int:
    """The offset a job starts from: one number."""
    return d.table("events").agg(F.max("event_id")).first()[0] // 2


def _envelopes(d: Data):
    image = lambda when: F.when(when, F.struct("id", "status", "amount", "event_time"))
    deleted = F.col("op") == "d"
    envelope = F.struct("op", "seq", image(deleted).alias("before"), image(~deleted).alias("after"))
    return d.fixture("chg").select(
        F.to_json(envelope, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("body"))


@register("SELECT id, status, amount, event_time, op, seq FROM chg", ("chg",))
def parse_changes(d: Data):
    return op.parse_changes(_envelopes(d), "body", ROW)


@register("SELECT id, seq, op, status, amount, event_time FROM (" + LAST.format(source="chg") + ") WHERE op <> 'd'", ("chg",))
def fold_changes(d: Data):
    return op.fold_changes(d.fixture("chg"), ["id"])


@register("SELECT id, status, amount, event_time FROM (" + LAST.format(source="chg") + ") WHERE op <> 'd'", ("chg",))
def apply_to_state(d: Data):
    """A kept state after two rounds of changes, the later ones first."""
    path, rows, middle = fresh_path(d.spark, "state"), d.fixture("chg"), _middle(d)
    for part in (rows.where(F.col("seq") > middle), rows.where(F.col("seq") <= middle)):
        state.apply_to_state(path, part, ["id"])
    return state.read_state(d.spark, path)


NOW_TWIN = "SELECT id, status, amount, event_time FROM (" + LAST.format(source="chg") + ") WHERE op <> 'd'"


@register(NOW_TWIN, ("chg",))
def grow_state(d: Data):
    """A kept state that splits from 8 to 27 partitions between three rounds of changes, the later ones first."""
    path, rows, middle = fresh_path(d.spark, "state"), d.fixture("chg"), _middle(d)
    state.apply_to_state(path, rows.where(F.col("seq") > middle), ["id"], parts=8)
    state.grow_state(d.spark, path, 20)
    state.apply_to_state(path, rows.where((F.col("seq") <= middle) & (F.col("seq") % 2 == 0)), ["id"])
    state.grow_state(d.spark, path, 27)
    state.apply_to_state(path, rows.where((F.col("seq") <= middle) & (F.col("seq") % 2 == 1)), ["id"])
    return state.read_state(d.spark, path)


@register(NOW_TWIN, ("chg",))
def read_table(d: Data):
    """Five batches of a stream; the state takes in those before the fourth, a read merges the others."""
    base, rows = fresh_path(d.spark, "table"), d.fixture("chg")
    fifth = F.floor((F.col("seq") - 1) * 5 / d.table("events").agg(F.max("event_id")).first()[0])
    for number in range(5):
        rows.where(F.least(fifth, F.lit(4)) == number).write.mode("append").parquet(f"{base}/in")
        stream = ingest.stream_files(d.spark, f"{base}/in", rows.schema)
        ingest.run_to_end(tables.ingest_batches(stream, f"{base}/table", f"{base}/checkpoint", once=True))
        if number == 2:
            tables.fold_tail(d.spark, f"{base}/table", ["id"], parts=16)
    return tables.read_table(d.spark, f"{base}/table", ["id"])


@register(NOW_TWIN, ("chg",))
def restore(d: Data):
    """A job that stopped at a savepoint, went on, and was taken back to it: the replay gives every change once."""
    base, rows, middle = fresh_path(d.spark, "savepoint"), d.fixture("chg"), _middle(d)

    def run(name):
        stream = ingest.stream_files(d.spark, f"{base}/in", rows.schema)
        ingest.run_to_end(tables.ingest_batches(stream, f"{base}/{name}", f"{base}/{name}-checkpoint", once=True))

    rows.where(F.col("seq") <= middle // 2).write.mode("append").parquet(f"{base}/in")
    run("first")
    tables.fold_tail(d.spark, f"{base}/first", ["id"], parts=8)
    rows.where((F.col("seq") > middle // 2) & (F.col("seq") <= middle)).write.mode("append").parquet(f"{base}/in")
    run("first")
    tables.savepoint(d.spark, f"{base}/first", f"{base}/first-checkpoint", f"{base}/kept")
    rows.where(F.col("seq") > middle).write.mode("append").parquet(f"{base}/in")
    run("first")
    tables.restore(d.spark, f"{base}/kept", f"{base}/second", f"{base}/second-checkpoint")
    run("second")
    return tables.read_table(d.spark, f"{base}/second", ["id"])


@register("""
    SELECT CAST(event_time AS DATE) AS day, count(*) AS rows, CAST(sum(CAST(round(amount * 10000) AS BIGINT)) AS BIGINT) AS total_units,
           min(amount) AS low, max(amount) AS high
    FROM (""" + LAST.format(source="chg") + """) WHERE op <> 'd' GROUP BY 1""", ("chg",))
def refresh(d: Data):
    """Rows, sum and range of a day, kept from one table version to the next and never computed from the whole."""
    rows, middle, path = d.fixture("chg"), _middle(d), fresh_path(d.spark, "refresh")
    versions = [op.fold_changes(part, ["id"]).select("id", F.to_date("event_time").alias("day"), "amount")
                for part in (rows.where(F.lit(False)), rows.where(F.col("seq") <= middle), rows)]
    for before, after in zip(versions, versions[1:]):
        retract.refresh(path, retract.signed(op.row_kinds(before, after, ["id"]), ["day"], "amount"), ["day"], 4)
    kept = retract.read_refreshed(d.spark, path)
    return kept.select("day", "rows", (F.col("total") * 10000).cast("long").alias("total_units"), "low", "high")


@register("SELECT concat('x', seq) AS body, 'not a change envelope' AS reason FROM chg WHERE seq % 5 = 0", ("chg",))
def bad_changes(d: Data):
    rows = d.fixture("chg").select("seq", F.to_json(F.struct("op", "seq", F.struct("id", "status").alias("after"))).alias("body"))
    return op.bad_changes(rows.select(F.when(F.col("seq") % 5 == 0, F.concat(F.lit("x"), "seq")).otherwise(F.col("body")).alias("body")), "body", ROW)


ORDER_CHANGES = """
    SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 1000000000 ELSE o_custkey END AS c_custkey,
           o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'd' ELSE 'u' END AS op,
           concat('order ', CAST(o_orderkey AS VARCHAR(20))) AS c_name, o_totalprice AS c_acctbal
    FROM {orders}"""

# Customers carry a change number of their own; a change with a smaller one is stale.
UPSERT_TWIN = """
    WITH change AS (
      SELECT * FROM (""" + ORDER_CHANGES.replace("{orders}", "orders") + """)
      QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) = 1
    ), merged AS (
      SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey,
             n.seq IS NOT NULL AND (c.c_custkey IS NULL OR n.seq >= c.c_custkey * 10) AS taken, n.op,
             c.c_custkey IS NOT NULL AS known,
             c.c_name AS old_name, n.c_name AS new_name, c.c_acctbal AS old_bal, n.c_acctbal AS new_bal
      FROM customer c FULL JOIN change n ON c.c_custkey = n.c_custkey
    )
    SELECT c_custkey, CASE WHEN taken THEN new_name ELSE old_name END AS c_name,
           CASE WHEN taken THEN new_bal ELSE old_bal END AS c_acctbal
    FROM merged WHERE NOT (taken AND op = 'd') AND (taken OR known)"""


def _upserted(d: Data, patch: bool):
    customer = d.table("customer").select("c_custkey", "c_name", "c_acctbal")
    state = op.to_state(customer.withColumn("version", F.col("c_custkey") * 10), "version").drop("version")
    changes = d.spark.sql(ORDER_CHANGES, orders=d.table("orders"))
    return op.visible(op.upsert(state, changes, ["c_custkey"], patch=patch))


@register(UPSERT_TWIN)
def upsert(d: Data):
    return _upserted(d, patch=False)


@register(UPSERT_TWIN)
def upsert_patch(d: Data):
    return _upserted(d, patch=True)


@register("""
    SELECT o_custkey AS id, 'order' AS status, o_totalprice AS amount, o_orderdate AS event_time FROM orders
    UNION ALL SELECT id, status, amount, event_time FROM chg WHERE op = 'c'""", ("chg",))
def append_changes(d: Data):
    target = d.table("orders").select(
        F.col("o_custkey").alias("id"), F.lit("order").alias("status"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("event_time"))
    return op.append_changes(target, d.fixture("chg"))


@register("SELECT id, status, amount, event_time FROM (" + LAST.format(source="chg") + ") WHERE op <> 'd'", ("chg",))
def full_then_incremental(d: Data):
    start, changes = _middle(d), d.fixture("chg")
    snapshot = op.fold_changes(changes.where(F.col("seq") <= start), ["id"]).drop("seq", "op")
    return op.full_then_incremental(snapshot, start, changes, ["id"])


@register(f"""
    SELECT id, seq, op, status, amount, event_time FROM (
      SELECT * FROM chg WHERE seq > {MIDDLE} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
    WHERE op <> 'd'""", ("chg",))
def incremental_only(d: Data):
    return op.incremental_only(d.fixture("chg"), _middle(d), ["id"])


@register(f"""
    WITH b AS (SELECT id, status, amount FROM (
           SELECT * FROM chg WHERE seq <= {MIDDLE} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) WHERE op <> 'd'),
         a AS (SELECT id, status, amount FROM (""" + LAST.format(source="chg") + """) WHERE op <> 'd'),
         j AS (SELECT coalesce(b.id, a.id) AS id, b.id IS NOT NULL AS had, a.id IS NOT NULL AS has,
                      b.status AS os, b.amount AS oa, a.status AS ns, a.amount AS na
               FROM b FULL JOIN a ON a.id = b.id)
    SELECT id, '+I' AS row_kind, ns AS status, na AS amount FROM j WHERE NOT had
    UNION ALL SELECT id, '-D', os, oa FROM j WHERE NOT has
    UNION ALL SELECT id, '-U', os, oa FROM j WHERE had AND has AND (os IS DISTINCT FROM ns OR oa IS DISTINCT FROM na)
    UNION ALL SELECT id, '+U', ns, na FROM j WHERE had AND has AND (os IS DISTINCT FROM ns OR oa IS DISTINCT FROM na)""", ("chg",))
def row_kinds(d: Data):
    changes, start = d.fixture("chg"), _middle(d)
    before = op.fold_changes(changes.where(F.col("seq") <= start), ["id"]).select("id", "status", "amount")
    after = op.fold_changes(changes, ["id"]).select("id", "status", "amount")
    return op.row_kinds(before, after, ["id"])


CURRENT_TWIN = "SELECT id, status, amount, event_time, op, seq FROM (" + LAST.format(source="chg") + ") WHERE op <> 'd'"


@register(CURRENT_TWIN, ("chg",))
def ingest_stream(d: Data):
    """Envelopes from files, through one checkpointed run, folded by the reader."""
    base = fresh_path(d.spark, "ingest")
    _envelopes(d).write.parquet(f"{base}/in")
    stream = op.parse_changes(ingest.stream_files(d.spark, f"{base}/in", "body string"), "body", ROW)
    ingest.run_to_end(ingest.ingest_stream(stream, f"{base}/log", f"{base}/checkpoint", once=True))
    return ingest.read_current(d.spark, f"{base}/log", ["id"])


@register("SELECT id, seq, op, status, amount, event_time FROM chg", ("chg",))
def resume_stream(d: Data):
    """Stopped after the first half and started again: every change is there once."""
    base, start = fresh_path(d.spark, "resume"), _middle(d)
    changes = d.fixture("chg")

    def run(start_job):
        stream = ingest.stream_files(d.spark, f"{base}/in", changes.schema)
        ingest.run_to_end(start_job(stream, f"{base}/log", f"{base}/checkpoint", once=True))

    changes.where(F.col("seq") <= start).write.mode("append").parquet(f"{base}/in")
    run(ingest.ingest_stream)
    changes.where(F.col("seq") > start).write.mode("append").parquet(f"{base}/in")
    run(ingest.resume_stream)
    return d.spark.read.parquet(f"{base}/log")


@register("""
    WITH fetched AS (
      SELECT event_type AS source, event_id, ts, ts + to_milliseconds(CAST(floor(value * 10) AS BIGINT)) AS fetched_at FROM events
    ), lagged AS (SELECT source, fetched_at, datediff('microsecond', ts, fetched_at) // 1000 AS lag_ms FROM fetched)
    SELECT source, CAST(max(row(fetched_at, lag_ms))[2] AS BIGINT) AS lag_ms, max(lag_ms) AS max_lag_ms
    FROM lagged GROUP BY source""")
def lag_by_source(d: Data):
    fetched = d.table("events").select(
        F.col("event_type").alias("source"), "ts",
        F.timestamp_add("MILLISECOND", F.floor(F.col("value") * 10).cast("int"), F.col("ts")).alias("fetched_at"))
    return metrics.lag_by_source(fetched, "source", "ts", "fetched_at")


@register("""
    SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS rows, count(*) / 3600.0::DOUBLE AS rows_per_second
    FROM events GROUP BY ALL""")
def throughput(d: Data):
    return metrics.throughput(d.table("events"), "ts", "1 hour", ["event_type"])
