"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docpipe.plans import catalog_fields, catalog_flow, catalog_layout, catalog_prices
from docpipe.plans.inputs import plain

PARTS = (catalog_fields, catalog_prices, catalog_layout, catalog_flow)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: plain(sql) for part in PARTS for name, sql in part.ORACLES.items()}
