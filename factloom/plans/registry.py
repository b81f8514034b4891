"""Registered queries and their DuckDB oracles, gathered from the modules of this folder."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each subject is first seen, of what kind, and how often."""
    return QUERIES["d1_derive_facts"](spark, sf_dir)


for _module in ("facts", "profile", "resolution", "edges", "evidence", "gates", "timelines", "pages", "text", "io"):
    importlib.import_module(f"factloom.plans.{_module}")
