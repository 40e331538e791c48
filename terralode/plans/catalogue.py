"""The registered queries: name -> (Spark query, the same in DuckDB's SQL, if SQL can say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terralode.plans import changes, columns, dashboards, entities, filters, layers, parcels, polygons, projections, rasters, registry, relational, series, spatial, terrain, texts  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in registry.ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in registry.ENTRIES.items() if sql}
