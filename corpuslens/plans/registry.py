"""name → (query, oracle SQL).  Query modules register on import."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("relational", "aggregation", "texts", "ingest", "agreement", "bias", "coverage", "streams")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables as DataFrames, read on access."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name, with the DuckDB text that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"corpuslens.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["council_consensus"](spark, sf_dir)
