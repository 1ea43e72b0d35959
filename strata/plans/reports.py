"""Ad-hoc queries, reports and query history."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.quality import search

# The catalog statements that may run besides queries.
CATALOG_STATEMENTS = ("SHOW", "DESCRIBE", "DESC", "EXPLAIN")


def run_query(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Rows of one read-only statement, whole.

    A query runs as a subquery, where Spark's grammar admits nothing that writes and no second
    statement. Catalog statements run as they are.
    """
    text = re.sub(r";\s*$", "", sql.strip())
    if not text:
        raise ValueError("no SQL given")
    if text.split(None, 1)[0].upper() in CATALOG_STATEMENTS:
        return spark.sql(text)
    return spark.sql(f"SELECT * FROM (\n{text}\n) AS result", args=args or {}, **tables)


@dataclass
class Result:
    """Rows of a query, all of them or the first ``cap`` with the flag ``truncated`` on each."""

    source: DataFrame
    cap: int | None = None

    @property
    def rows(self) -> DataFrame:
        """All rows, or the first ``cap`` and a column ``truncated``."""
        return self.source if self.cap is None else capped(self.source, self.cap)


def capped(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows with a column ``truncated`` that tells whether there were more.

    Both the rows and the flag stop reading at the cap: the flag is one value, whether a row beyond it is there.
    """
    if n < 0:
        raise ValueError("a row cap cannot be negative")
    more = df.limit(n + 1).agg(F.count(F.lit(1)) > n).scalar()
    return df.limit(n).withColumn("truncated", more)


def adhoc_query(spark: SparkSession, sql: str, max_rows: int | None = None, args: dict | None = None,
                **tables: DataFrame) -> Result:
    """A user's query; without ``max_rows`` its whole result."""
    return Result(run_query(spark, sql, args, **tables), max_rows)


@dataclass(frozen=True)
class Report:
    report_id: int
    sql: str
    published: bool = False
    params: tuple[str, ...] = ()


def report_data(spark: SparkSession, report: Report, args: dict | None = None, max_rows: int | None = None,
                **tables: DataFrame) -> Result:
    """Rows of a published report with its filter values bound as named parameters."""
    if not report.published:
        raise ValueError(f"report {report.report_id} is not published")
    unknown = set(args or {}) - set(report.params)
    if unknown:
        raise ValueError(f"report {report.report_id} has no parameter {sorted(unknown)}")
    return adhoc_query(spark, report.sql, max_rows, args, **tables)


def history_page(history: DataFrame, user, page: int = 0, size: int = 20, after: tuple | None = None) -> DataFrame:
    """One page of a user's queries, newest first.

    ``after`` is the (created_at, id) of the last row seen: a deep page then costs as little as the first.
    """
    if size < 1 or page < 0:
        raise ValueError("a page needs a size of 1 or more and a number of 0 or more")
    own = history.where(F.col("user_id") == user)
    if after is not None:
        time, id_ = (F.lit(value) for value in after)
        own = own.where((F.col("created_at") < time) | ((F.col("created_at") == time) & (F.col("id") < id_)))
    return own.orderBy(F.desc("created_at"), F.desc("id")).offset(page * size).limit(size)


def history_by_status(history: DataFrame, status: str) -> DataFrame:
    return search(history, "created_at", "id", status=status)
