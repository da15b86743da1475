"""Registry of queries: key -> (Spark job, DuckDB oracle SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

_MODULES = (
    "q_features",
    "q_clean",
    "q_intercase",
    "q_targets",
    "q_split",
    "q_encode",
    "q_models",
    "q_flow",
    "q_report",
    "q_io",
    "q_stream",
)


def register(key: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def load_all() -> None:
    for mod in _MODULES:
        importlib.import_module(f"procmon.plans.{mod}")


# SQL snippets shared by oracle statements: units as doubles, like functions/time.py
def sql_unit(micros_sql: str, unit: str) -> str:
    from procmon.functions.time import UNIT_US

    return f"CAST({micros_sql} AS DOUBLE) / CAST({UNIT_US[unit]} AS DOUBLE)"


W1 = "WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)"
