"""Registration of runnable queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayside.plans.testmap import Model, with_tables

QUERIES: dict[str, Callable[[Model], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EXTRA_TABLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(model) -> DataFrame`` with the SQL for the same rows."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def extra_tables(**tables: str) -> None:
    """Named SQL tables shared by several checks."""
    EXTRA_TABLES.update(tables)


_MODELS: dict[tuple[str, str], Model] = {}


def model_for(spark: SparkSession, sf_dir: str) -> Model:
    """One model per application and folder, so that queries share its stored tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = Model(spark, sf_dir)
    return _MODELS[key]


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(model_for(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(sql, EXTRA_TABLES) for name, sql in ORACLES.items()}
