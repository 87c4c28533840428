"""Variant-informative sites, barcode clusters by abundance, rolling neighbours, top segments and peaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import cut_lineage

#: Patterns of a window in a block that meets others.
PATTERN_ROWS = 16_384
#: Bases that a reference base may be read as, by chemistry strand.
ACCEPTED = {"top": {"A": "A", "C": "CT", "G": "G", "T": "T"}, "bottom": {"A": "A", "C": "C", "G": "AG", "T": "T"}}


def accepted(base: Column, strand: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in ACCEPTED[strand].items() for x in (k, v)]), base)


def informative_sites(pairs: DataFrame, strand: str = "top") -> DataFrame:
    """Aligned columns (position, a, b) with their status: same, callable, or not callable because accepted sets meet or a gap stands there."""
    x, y = accepted(F.col("a"), strand), accepted(F.col("b"), strand)
    meet = F.size(F.array_intersect(F.split(x, ""), F.split(y, ""))) > 0
    gap = F.col("a").isin("-", "N") | F.col("b").isin("-", "N")
    return pairs.withColumn("status", F.when(F.col("a") == F.col("b"), "same").when(gap, "indel_or_unknown").when(meet, "overlapping_sets").otherwise("callable"))


def site_calls(observed: DataFrame, sites: DataFrame, strand: str = "top") -> DataFrame:
    """Observed bases at callable sites: 1 or 2 for a member's accepted base, 0 for neither."""
    rows = observed.join(sites.where("status = 'callable'").select("position", "a", "b"), "position")
    first, second = F.contains(accepted(F.col("a"), strand), F.col("base")), F.contains(accepted(F.col("b"), strand), F.col("base"))
    return rows.withColumn("variant", F.when(F.col("base") == "N", F.lit(None)).when(first, 1).when(second, 2).otherwise(0))


def conversion_rates(marks: DataFrame, key: str, strand: str, converted: str) -> DataFrame:
    """Efficiency and error of each read: its best and worst strand's share of converted bases, within [0.05, 0.99] and [0.001, 0.10]."""
    per = marks.groupBy(key, strand).agg(F.avg(F.col(converted).cast("double")).alias("f"))
    both = per.groupBy(key).agg(F.max("f").alias("hi"), F.min("f").alias("lo"), F.count("*").alias("strands"))
    lo = F.when(F.col("strands") > 1, F.col("lo")).otherwise(0.0)
    clip = lambda c, a, b: F.least(F.greatest(c, F.lit(a)), F.lit(b))
    return both.select(key, clip(F.col("hi"), 0.05, 0.99).alias("efficiency"), clip(lo, 0.001, 0.10).alias("error"))


def profile_peaks(profile: DataFrame, keys: tuple[str, ...], position: str, value: str, least: float) -> DataFrame:
    """Strict local maxima of a profile that reach `least` times its mean."""
    w = Window.partitionBy(*keys).orderBy(position)
    mean = F.avg(value).over(Window.partitionBy(*keys))
    v = F.col(value)
    marked = profile.withColumn("_p", (v > F.lag(value).over(w)) & (v >= F.lead(value).over(w)) & (v >= least * mean))
    return marked.where("_p").drop("_p")


def directional_clusters(counts: DataFrame, group: tuple[str, ...], value: str, most: int = 1) -> DataFrame:
    """Barcodes absorbed, in the order of their counts, by the first unassigned centre within an edit distance; a group's distinct barcodes are one task's (bounded by the barcode length)."""
    kinds = dict(counts.dtypes)

    def close(a: str, b: str) -> bool:
        if abs(len(a) - len(b)) > most:
            return False
        if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= most:
            return True
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1] <= most

    def variants(v: str) -> Iterator[str]:
        for k in range(len(v)):
            yield f"{k}:{v[:k]}.{v[k + 1 :]}"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["reads", value], ascending=[False, True])
        names = pdf[value].tolist()
        index: dict[str, list[str]] = {}
        if most == 1:
            for n in names:
                for v in variants(n):
                    index.setdefault(v, []).append(n)
        centre: dict[str, str] = {}
        for n in names:
            if n not in centre:
                centre[n] = n
                near = {m for v in variants(n) for m in index[v]} if most == 1 else names
                for m in near:
                    if m not in centre and close(n, m):
                        centre[m] = n
        return pdf.assign(centre=[centre[n] for n in names])[[*group, value, "reads", "centre"]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*group, value, "reads"))
    return counts.groupBy(*group).applyInPandas(one, f"{schema}, centre {kinds[value]}")


def rolling_neighbours(calls: DataFrame, group: tuple[str, ...], width: int, window: int, step: int, least: int) -> DataFrame:
    """For each read and window, the least share of differing calls to any other read of the group.

    Reads with the same calls in a window are one pattern, and patterns are compared, not reads: a window has
    at most 3^window patterns, however many reads there are.
    """
    bit = F.expr(f"shiftleft(1L, cast(position % {64} as int))")
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("position") - window + 1) / step) * step).cast("long"), F.least(F.floor(F.col("position") / step) * step, F.lit((width - window) // step * step)).cast("long"), F.lit(step).cast("long"))
    seen = calls.where("call is not null").withColumn("_b", bit)
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("position") - window + 1) / step) * step), F.least(F.floor(F.col("position") / step) * step, F.lit((width - window) // step * step))
    rows = seen.where(lo <= hi).withColumn("start", F.explode(starts))
    reads = rows.groupBy(*group, "start", "read_id").agg(F.bit_or("_b").alias("v"), F.bit_or(F.when(F.col("call") > 0, F.col("_b")).otherwise(F.lit(0).cast("long"))).alias("b"))
    reads = cut_lineage(reads)
    keys = (*group, "start")
    patterns = cut_lineage(reads.groupBy(*keys, "v", "b").agg(F.count("*").alias("n")).where(F.bit_count("v") >= least))
    # A pattern of two reads or more is at no distance of itself; the others are searched for, in blocks that all meet.
    alone = patterns.where("n = 1")
    parts = lambda x: F.ceil(x / PATTERN_ROWS).cast("int")
    sizes = patterns.groupBy(*keys).agg(parts(F.count("*")).alias("hb"), parts(F.sum((F.col("n") == 1).cast("long"))).alias("sb")).where("sb > 0")
    every = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    dealt = lambda x: F.pmod(F.xxhash64("v", "b"), F.col(x)).cast("int")
    home = patterns.join(sizes, [*keys]).select(*keys, dealt("hb").alias("hp"), every("sb").alias("sp"), "v", "b")
    seek = alone.join(sizes, [*keys]).select(*keys, every("hb").alias("hp"), dealt("sb").alias("sp"), "v", "b")
    seek = seek.select(*[F.col(c).alias(c) for c in seek.columns])  # columns of its own beside home's
    kinds = dict(seek.dtypes)

    def nearest(seek: pa.Table, home: pa.Table) -> pa.Table:
        v, b, hv, hb = (t[c].to_numpy().astype(np.int64).view(np.uint64) for t in (seek, home) for c in ("v", "b"))
        if window <= 16 and len(seek):  # turned so that the window's bits are the lowest
            r = seek["start"][0].as_py() % 64
            v, b, hv, hb = (((x >> np.uint64(r)) | (x << np.uint64((64 - r) % 64))).astype(np.uint16) for x in (v, b, hv, hb))
        # Shares by rank: a cell's shared and differing calls name its rank, the last of which is no share.
        share = np.array([[d / n if n >= max(least, 1) and d <= n else np.inf for d in range(65)] for n in range(65)]).reshape(-1)
        values, rank = np.unique(share, return_inverse=True)
        rank, best = rank.astype(np.uint16), np.full(len(v), len(values) - 1, np.uint16)
        for i in range(0, len(v) if len(hv) else 0, 64):
            part = slice(i, i + 64)
            both = v[part, None] & hv
            cell = rank[np.bitwise_count(both).astype(np.uint16) * np.uint16(65) + np.bitwise_count((b[part, None] ^ hb) & both)]
            cell[(v[part, None] == hv) & (b[part, None] == hb)] = len(values) - 1
            best[part] = cell.min(axis=1)
        at = np.flatnonzero(np.isfinite(values[best]))
        return seek.select([*keys, "v", "b"]).take(pa.array(at)).append_column("distance", pa.array(values[best][at]))

    by = (*keys, "hp", "sp")
    found = seek.groupBy(*by).cogroup(home.groupBy(*by)).applyInArrow(nearest, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "v", "b")) + ", distance double")
    best = found.groupBy(*keys, "v", "b").agg(F.min("distance").alias("distance")).unionByName(patterns.where("n > 1").select(*keys, "v", "b", F.lit(0.0).alias("distance")))
    return reads.join(best, [*keys, "v", "b"]).select(*group, "read_id", "start", "distance")


def top_segments(segments: DataFrame, key: str, partner: str, most: int, overlap: int, least: int) -> DataFrame:
    """The longest segment with each partner, then partners longest first, skipping what overlaps a chosen one too much; up to `most` a read."""
    first = F.row_number().over(Window.partitionBy(key, partner).orderBy(F.desc(F.col("end") - F.col("start")), "start"))
    best = segments.where(F.col("end") - F.col("start") >= least).withColumn("_r", first).where("_r = 1").drop("_r").select(key, partner, "start", "end")

    item = F.struct((F.col("start") - F.col("end")).alias("o"), "start", F.col(partner).alias("partner"), "end")
    listed = best.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("a"))
    none = F.filter("a", lambda x: F.lit(False))

    def step(done: Column, x: Column) -> Column:
        free = F.forall(done, lambda c: F.least(c["end"], x["end"]) - F.greatest(c["start"], x["start"]) <= overlap)
        return F.when((F.size(done) < most) & free, F.concat(done, F.array(x))).otherwise(done)

    chosen = listed.select(key, F.posexplode(F.aggregate("a", none, step)).alias("i", "x"))
    return chosen.select(key, F.col("x.partner").alias(partner), F.col("x.start").alias("start"), F.col("x.end").alias("end"), (F.col("i") + 1).cast("long").alias("rank"))


def weighted_decay(points: DataFrame, keys: tuple[str, ...], lag: str, height: str, weight: str) -> DataFrame:
    """Slope and intercept of log height on lag by weighted sums; heights of 0 or less are left out."""
    rows = points.where(F.col(height) > 0).withColumn("_y", F.ln(height)).withColumn("_x", F.col(lag).cast("double"))
    w, x, y = F.col(weight), F.col("_x"), F.col("_y")
    s = rows.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.count("*").alias("n"))
    slope = F.try_divide(F.col("w") * F.col("xy") - F.col("x") * F.col("y"), F.col("w") * F.col("xx") - F.col("x") * F.col("x"))
    return s.select(*keys, "n", slope.alias("slope"), ((F.col("y") - slope * F.col("x")) / F.col("w")).alias("intercept"))
