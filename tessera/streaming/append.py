"""Append-only ingestion: plan against a manifest, refuse collisions, and commit exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transition(previous: DataFrame, current: DataFrame, key: str, content: str) -> str:
    """identical, append_only, removed, content_mutated or replaced, from two manifests (source, digest)."""
    a = previous.select(F.col(key).alias("k"), F.col(content).alias("a"))
    b = current.select(F.col(key).alias("k"), F.col(content).alias("b"))
    n = a.join(b, "k", "full").agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("gone"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a") == F.col("b")).alias("same")).collect()[0]
    if n["changed"]:
        return "content_mutated"
    if n["gone"]:
        return "replaced" if n["added"] and not n["same"] else "removed"
    return "append_only" if n["added"] else "identical"


def new_rows(table: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Arriving rows whose key the table does not hold, the first of equal keys once."""
    return arriving.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def collisions(table: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Keys that both hold."""
    return arriving.select(key).distinct().join(table.select(key), key, "left_semi")


def grown(fitted: DataFrame, current: DataFrame, key: str, digest: str) -> dict[str, int]:
    """Whether a fitted set may be extended: counts of removed, changed and new members (the first two must be 0)."""
    a = fitted.select(F.col(key).alias("k"), F.col(digest).alias("a"))
    b = current.select(F.col(key).alias("k"), F.col(digest).alias("b"))
    r = a.join(b, "k", "full").agg(F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a").isNull()).alias("new")).collect()[0]
    return r.asDict()
