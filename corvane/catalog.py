"""Every query of the library itself, by name, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "op_gr14_table_impact"
PLANS = "ingest sources rounds inspection ownership relations graph impact workflow scalars".split()
Query = Callable[[SparkSession, str], DataFrame]


class Plan:
    """The queries of one module: registered by name, with or without an equivalent SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


def _plans() -> list[Plan]:
    return [importlib.import_module(f"corvane.plans.{name}").PLAN for name in PLANS]


def queries() -> dict[str, Query]:
    return {name: f for plan in _plans() for name, f in plan.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _plans() for name, sql in plan.sql.items()}
