"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryframe.plans.fixtures import Fixtures

_QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("sequence_queries", "label_queries", "sweep_queries", "metric_queries", "evaluation_queries", "record_queries", "dataset_queries", "gate_queries", "chain_queries", "interval_queries")
_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the fixtures; ``sql`` is DuckDB SQL for the same rows."""

    def add(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def on_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, whatever their working folder is."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _HOME])


def _bind(f: Callable[[Fixtures], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_workers(spark)
        return f(Fixtures(spark, sf_dir))

    return run


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"quarryframe.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bind(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
