"""Named queries: a function of (spark, sf_dir) and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

import functools
import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under name; sql is its oracle."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return put


def load_plans() -> None:
    """Imports every module of tessera.plans, which fills the tables above."""
    from tessera import plans

    for m in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"{plans.__name__}.{m.name}")


def sql_query(name: str, tables: str, text: str, oracle: str | None = None, check: bool = True) -> None:
    """Registers a query written in SQL over the named tables. Its oracle is the same text, or another where the dialects part; check=False: none."""
    from tessera.sources.tables import views

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views(spark, sf_dir, *tables.split()).sql(text)

    query(name, (oracle or text) if check else None)(run)
