"""Registration of queries together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from strata.plans import fixtures


# Schemas of the given tables, read once: finding a schema takes a job of its own.
_SCHEMAS: dict[str, StructType] = {}


@dataclass(frozen=True)
class Data:
    """The given tables of one folder, and the inputs derived from them."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in names}

    def fixture(self, name: str) -> DataFrame:
        text = fixtures.SPARK_ONLY.get(name, fixtures.BOTH.get(name))
        return self.spark.sql(text, **self.tables(*fixtures.INPUTS[name]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None, uses: tuple[str, ...] = ()):
    """Register a function of ``Data`` under its name; ``uses`` names the derived inputs in its SQL."""
    def wrap(build: Callable[[Data], DataFrame]):
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Data(spark, folder))
        if oracle is not None:
            ORACLES[name] = fixtures.with_inputs(oracle, uses)
        return build
    return wrap
