"""Every registered query and its SQL twin, by key."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aislewise.sources.adapters import DriverTables

AREAS = ["catalogue", "cleaning", "features", "overview", "customers", "merchandising",
         "operations", "text", "models"]


def _areas():
    for name in AREAS:
        try:
            yield importlib.import_module(f"aislewise.plans.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"aislewise.plans.{name}":
                raise


def _bind(build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(DriverTables(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _bind(build) for area in _areas() for key, build in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for area in _areas() for key, sql in area.ORACLES.items()}
