"""Every query of the engine by name, with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "factloom.plans.table_queries",
    "factloom.operators.tabular_queries",
    "factloom.operators.document_queries",
    "factloom.operators.fact_queries",
    "factloom.operators.world_queries",
    "factloom.operators.model_queries",
    "factloom.operators.view_queries",
    "factloom.operators.branch_queries",
    "factloom.operators.fulltext_queries",
    "factloom.operators.vector_queries",
    "factloom.sources.versioned_queries",
    "factloom.streaming.queue_queries",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(_name)
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
