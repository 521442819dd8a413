"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import Catalog, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, plan: Callable[[Catalog], DataFrame], body: str | None = None) -> None:
    """Registers a plan over the catalog and the SQL that gives the same rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(Catalog(spark, sf_dir))

    QUERIES[name] = run
    if body:
        ORACLE_SQL[name] = sql(body)


for _module in ("scan", "filter", "join", "aggregate", "rank", "text", "content", "parse", "graph", "stream", "audit"):
    importlib.import_module(f"{__package__}.{_module}_queries")
