"""Selections: declarative predicates, range filters, interval overlap, and index scans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)), "not_in": lambda c, v: ~c.isin(list(v)), "is_null": lambda c, v: c.isNull(), "not_null": lambda c, v: c.isNotNull()}


def predicate(tree: Mapping[str, Any], columns: Iterable[str]) -> Column:
    """A tree of all / any / not and {column, op, value, missing} leaves as one Column.

    `missing` rules for an absent column and for null values: fail (an absent column is an error, a null is false), true or false.
    """
    if "all" in tree:
        return reduce(lambda a, b: a & b, [predicate(x, columns) for x in tree["all"]], F.lit(True))
    if "any" in tree:
        return reduce(lambda a, b: a | b, [predicate(x, columns) for x in tree["any"]], F.lit(False))
    if "not" in tree:
        return ~predicate(tree["not"], columns)
    name, op, missing = tree["column"], tree["op"], tree.get("missing", "fail")
    if op not in COMPARE:
        raise ValueError(f"unknown operation {op}")
    if name not in columns:
        if missing == "fail":
            raise KeyError(name)
        return F.lit(missing == "true")
    made = COMPARE[op](F.col(name), tree.get("value"))
    return made if op.endswith("null") else F.coalesce(made, F.lit(missing == "true"))


def suffix_filters(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Filters spelled column__min, __max, __in, __not_in or __eq; nulls fail."""
    for key, value in filters.items():
        name, _, op = key.rpartition("__")
        if not name:
            name, op = key, "eq"
        if name not in df.columns:
            raise KeyError(name)
        c = F.col(name)
        df = df.where({"min": lambda: c >= value, "max": lambda: c <= value, "in": lambda: c.isin(list(value)), "not_in": lambda: ~c.isin(list(value)), "eq": lambda: c == value}[op]())
    return df


def in_range(c: Column, bounds: tuple[float | None, float | None] | None) -> Column:
    """Inclusive range; None leaves a side open; reversed bounds are swapped; null fails when a side is set."""
    lo, hi = bounds or (None, None)
    if lo is not None and hi is not None and lo > hi:
        lo, hi = hi, lo
    ok = F.lit(True)
    if lo is not None:
        ok = ok & F.coalesce(c >= lo, F.lit(False))
    if hi is not None:
        ok = ok & F.coalesce(c <= hi, F.lit(False))
    return ok


def read_quality(df: DataFrame, **ranges: tuple[float | None, float | None]) -> Column:
    """AND of ranges on read_length, mapped_length, length_ratio, mapped_length_ratio, mapped_to_read_ratio, read_quality and mapping_quality; a range whose columns are absent is skipped."""
    made = {"length_ratio": ("read_length", "reference_length"), "mapped_length_ratio": ("mapped_length", "reference_length"), "mapped_to_read_ratio": ("mapped_length", "read_length")}
    ok = F.lit(True)
    for name, bounds in ranges.items():
        if name in made:
            top, bottom = made[name]
            if {top, bottom} <= set(df.columns):
                ok = ok & in_range(F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")), bounds)
        elif name in df.columns:
            ok = ok & in_range(F.col(name), bounds)
    return ok


def overlaps(start: Column, end: Column, lo: Column | int, hi: Column | int) -> Column:
    """Half-open intervals that share a position."""
    return (start < hi) & (end > lo)


def scan_index(df: DataFrame, *, start: int | None = None, end: int | None = None, columns: list[str] | None = None, order: tuple[str, ...] = (), distinct: tuple[str, ...] = (), **values: Iterable[Any]) -> DataFrame:
    """An index scan: membership filters by column, window overlap on reference_start/_end, optional duplicate removal, projection, order."""
    if (start is None) != (end is None):
        raise ValueError("start and end come together")
    for name, wanted in values.items():
        if name not in df.columns:
            raise KeyError(name)
        df = df.where(F.col(name).isin(list(wanted)))
    if start is not None:
        df = df.where(overlaps(F.col("reference_start"), F.col("reference_end"), start, end))
    if distinct:
        df = df.dropDuplicates(list(distinct))
    if order:
        df = df.orderBy(*order)
    return df.select(*columns) if columns else df


def drop_sparse(calls: DataFrame, axis: str, total: int | Column, threshold: float, value: str = "call") -> DataFrame:
    """Rows whose axis value has a share of missing values up to threshold; total is how many each could have."""
    keep = calls.groupBy(axis).agg(F.count(value).alias("_seen")).where(1 - F.col("_seen") / total <= threshold).select(axis)
    return calls.join(keep, axis, "left_semi")


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: tuple[str, ...] = (), bin_width: int = 64) -> DataFrame:
    """Pairs of rows whose half-open spans overlap: both sides explode into bins, and a pair meets in the first bin they share only.

    The equi-join is on (keys, bin), so it hash-partitions; a long interval costs its length over bin_width in rows.
    """
    ls, le = left_span
    rs, re_ = right_span
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.col(e) - 1) / bin_width)))
    a = left.where(F.col(ls) < F.col(le)).withColumn("_bin", bins(ls, le)).alias("l")
    b = right.where(F.col(rs) < F.col(re_)).withColumn("_bin", bins(rs, re_)).alias("r")
    same = reduce(lambda x, k: x & (F.col(f"l.{k}") == F.col(f"r.{k}")), on, F.col("l._bin") == F.col("r._bin"))
    first = F.floor(F.greatest(F.col(f"l.{ls}"), F.col(f"r.{rs}")) / bin_width) == F.col("l._bin")
    joined = a.join(b, same & first & overlaps(F.col(f"l.{ls}"), F.col(f"l.{le}"), F.col(f"r.{rs}"), F.col(f"r.{re_}")))
    kept = [F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns if c not in left.columns]
    return joined.select(*kept)


def point_in_span(points: DataFrame, spans: DataFrame, point: str, span: tuple[str, str], value: str, default: Any, on: tuple[str, ...] = (), bin_width: int = 64) -> DataFrame:
    """points with the value of the span that contains them, or a default; of several spans the one that starts last, then the greatest value."""
    s, e = span
    keys = [*on, point]
    binned = spans.where(F.col(s) < F.col(e)).select(*on, F.col(s).alias("_s"), F.col(e).alias("_e"), F.col(value).alias("_v"), F.explode(F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.col(e) - 1) / bin_width))).alias("_bin"))
    # Each place is resolved once, whatever the number of points there; points then look their place up, repeated ones too.
    places = points.select(*keys).distinct().withColumn("_bin", F.floor(F.col(point) / bin_width))
    hits = places.join(binned, [*on, "_bin"]).where((F.col("_s") <= F.col(point)) & (F.col(point) < F.col("_e")))
    found = hits.groupBy(*keys).agg(F.max(F.struct("_s", "_v"))["_v"].alias("_v"))
    return points.join(found, keys, "left").select(*[F.col(c) for c in points.columns], F.coalesce("_v", F.lit(default)).alias(value))
