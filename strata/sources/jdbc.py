"""Row-store tables over JDBC."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

# Source systems and their driver classes.
DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver",
    "postgresql": "org.postgresql.Driver",
}


def jdbc_options(url: str, table: str, key: str | None = None, bounds: tuple | None = None,
                 parts: int = 1, fetch_size: int = 10_000, **extra) -> dict[str, str]:
    """Options of one table read. ``parts`` > 1 needs a split ``key`` and its ``bounds``.

    The bounds only place the cuts: rows outside them fall into the first and last part.
    """
    system = url.split(":")[1] if url.startswith("jdbc:") else ""
    if not system:
        raise ValueError(f"not a JDBC url: {url}")
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if system in DRIVERS:
        options["driver"] = DRIVERS[system]
    if parts > 1:
        if key is None or bounds is None:
            raise ValueError("a split read needs key and bounds")
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]),
                    "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return options | {name: str(value) for name, value in extra.items()}


def key_bounds(spark: SparkSession, url: str, table: str, key: str, **extra) -> tuple:
    """Smallest and largest key, computed by the source: one row travels."""
    query = f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) bounds"
    return tuple(spark.read.format("jdbc").options(**jdbc_options(url, query, **extra)).load().first())


def cut_query(table: str, key: str, parts: int) -> str:
    """A subquery for the source: the smallest key of each of ``parts`` equally large shares of its rows."""
    return (f"(SELECT MIN({key}) AS cut FROM (SELECT {key}, NTILE({parts}) OVER (ORDER BY {key}) AS share FROM {table} "
            f"WHERE {key} IS NOT NULL) shares GROUP BY share) cuts")


def _literal(value) -> str:
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        return "'" + str(value).replace("'", "''") + "'"
    return str(value)


def split_predicates(key: str, cuts: Sequence) -> list[str]:
    """Conditions that deal all rows to reads of equal size: each row, null keys too, meets exactly one.

    ``cuts`` are the smallest keys of the shares. A key with more rows than a share takes several cuts, which fall
    together, so that it is read by one task and its neighbours by others.
    """
    inner = sorted(set(cuts))[1:]
    if not inner:
        return ["1 = 1"]
    names = [_literal(cut) for cut in inner]
    between = [f"{key} >= {low} AND {key} < {high}" for low, high in zip(names, names[1:])]
    return [f"{key} < {names[0]} OR {key} IS NULL", *between, f"{key} >= {names[-1]}"]


def read_evenly(spark: SparkSession, url: str, table: str, key: str, parts: int, **extra) -> DataFrame:
    """A source table in reads of equally many rows, however its keys are spread.

    The source sorts the key once to find the cuts; at most ``parts`` rows travel for it.
    """
    cuts = spark.read.format("jdbc").options(**jdbc_options(url, cut_query(table, key, parts), **extra)).load()
    options = jdbc_options(url, table, **extra)
    options.pop("dbtable")
    return spark.read.jdbc(options.pop("url"), table, predicates=split_predicates(key, [row[0] for row in cuts.collect()]), properties=options)


def split_or_whole(key: str, bounds: tuple, parts: int) -> tuple:
    """Key, bounds and parts of a read; of a whole read where the source has no key value."""
    return (None, None, 1) if None in bounds else (key, bounds, parts)


def read_source(spark: SparkSession, url: str, table: str, key: str | None = None,
                bounds: tuple | None = None, parts: int = 1, **extra) -> DataFrame:
    """A source table as a DataFrame; filters and column choice are pushed to the source.

    One part is for small tables: a table of any size needs ``parts`` and a split ``key``. A source
    without rows has no bounds and is read unsplit.
    """
    if parts > 1 and key and bounds is None:
        bounds = key_bounds(spark, url, table, key, **extra)
        key, bounds, parts = split_or_whole(key, bounds, parts)
    return spark.read.format("jdbc").options(**jdbc_options(url, table, key, bounds, parts, **extra)).load()
