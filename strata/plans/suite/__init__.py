"""Registered queries with their SQL twins, one module per area."""

from pyspark.sql import DataFrame, SparkSession

from strata.operators.changes import fold_changes
from strata.operators.quality import Rule, run_checks
from strata.plans.registry import ORACLES, QUERIES, Data
from strata.plans.suite import (  # noqa: F401
    catalog, changes, layers, lineage, maintenance, monitor, quality, reports, sources,
)

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Changelog folded to the current table, which three rules then check: the alert rows."""
    current = fold_changes(Data(spark, folder).fixture("chg"), ["id"])
    rules = [
        Rule(1, "range_check", "current", None, 0.1, "amount < 80", "dwd"),
        Rule(2, "uniqueness", "current", "status", 0.5, None, "dwd"),
        Rule(3, "volume_compare", "current", None, 1_000_000.0, None, "dwd"),
        Rule(4, "null_rate", "current", "amount", 0.0, None, "dwd"),
    ]
    return run_checks(spark, rules, lambda name: current)
