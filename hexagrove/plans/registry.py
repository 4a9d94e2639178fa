"""All queries of the hexagon analytics, by operator ID, with their oracles.

A query is registered with its DuckDB oracle beside it; both name the same columns.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _QUERIES[name] = function
        if sql:
            _ORACLES[name] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Modules whose import registers queries.
MODULES = ("aggregates", "domain", "frames", "globe", "rules", "scans", "shapes", "siting", "spatial", "surfaces", "text", "windows")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"hexagrove.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["A4_cell_rollup"](spark, sf_dir)
