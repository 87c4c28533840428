"""Registered queries, the project catalog and planning."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import registry

MODULES = ("q_select", "q_agg", "q_window", "q_set", "q_stats", "q_models", "q_ml", "q_stream", "q_catalog", "q_more", "q_files")


def _loaded() -> None:
    for name in MODULES:
        import_module(f"tessera.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _loaded()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(registry.ORACLES)
