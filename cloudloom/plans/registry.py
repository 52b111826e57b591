"""The named queries of the point-set engine over the tables of a folder, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
CATALOGS = ("catalog_points", "catalog_spatial", "catalog_models", "catalog_learning", "catalog_fields", "catalog_supervoxels", "catalog_starts")


def rounded(c: Column, name: str) -> Column:
    """Six decimals, without a negative zero: comparable between engines."""
    return (F.round(c, 6) + 0.0).alias(name)


def query(name: str, oracle: str | None = None):
    """Registers a plan over ``Views`` as a query (spark, sf_dir)."""

    def register(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from cloudloom.sources.views import Views

            return plan(Views(spark, sf_dir))

        run.plan, run.__doc__, run.__name__ = plan, plan.__doc__, name
        _queries[name] = run
        if oracle is not None:
            _oracles[name] = oracle
        return run

    return register


def load() -> None:
    for c in CATALOGS:
        importlib.import_module(f"cloudloom.plans.{c}")


def queries() -> dict[str, Query]:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_oracles)
