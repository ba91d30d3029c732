"""The registered queries by name: a function of (spark, folder), and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchstone.plans.lakehouse import Lakehouse
from touchstone.plans.oracles import statement

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = statement(oracle)


def over_tables(name: str, oracle: str | None = None):
    """Register a plan over the lakehouse tables."""

    def register(plan: Callable[[Lakehouse], DataFrame]) -> Callable[[Lakehouse], DataFrame]:
        add(name, lambda spark, folder: plan(Lakehouse.over_test_tables(spark, folder)), oracle)
        return plan

    return register


def over_deployed(name: str, oracle: str | None = None):
    """Register a plan over the models of the last build, or over planned ones while there is none."""

    def register(plan: Callable[[Lakehouse], DataFrame]) -> Callable[[Lakehouse], DataFrame]:
        add(name, lambda spark, folder: plan(Lakehouse.deployed(spark, folder)), oracle)
        return plan

    return register


def over_folder(name: str, oracle: str | None = None):
    """Register a plan that reads its own tables."""

    def register(query: Query) -> Query:
        add(name, query, oracle)
        return query

    return register
