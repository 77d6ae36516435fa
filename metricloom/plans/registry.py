"""Named queries over the bundled tables, each with the survey items it covers and its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from metricloom.sources.tables import load


class Tables:
    """The tables of one directory as attributes: ``t.orders``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load(self.spark, self.directory, name)


@dataclass(frozen=True)
class Query:
    name: str
    items: tuple
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.plan(Tables(spark, directory))


REGISTRY: dict[str, Query] = {}


def query(items: str, sql: str | None = None):
    """Register a plan function under its own name."""
    def add(plan):
        if plan.__name__ in REGISTRY:
            raise ValueError(f"duplicate query {plan.__name__}")
        REGISTRY[plan.__name__] = Query(plan.__name__, tuple(items.split()), plan, sql)
        return plan
    return add
