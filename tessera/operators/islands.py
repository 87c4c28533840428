"""Operators along an ordered axis: fills, runs, merges, size classes, segments, rolling frames, lags.

All of them partition by the track (a read, a user) and order inside it, so one shuffle by track serves a
whole chain of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tessera.operators.ragged import flat, numbers


def track(keys: tuple[str, ...], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def fill_closest(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, out: str) -> DataFrame:
    """Forward, then backward fill."""
    w = track(keys, order)
    ahead = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(out, F.coalesce(ahead, back))


def encodings(value: Column) -> dict[str, Column]:
    """The other encodings of a missing value: 0 with calls -1 and 1, 1 with calls shifted up, -1, and a half."""
    return {"nan0_0minus1": F.when(value.isNull(), 0).when(value == 0, -1).otherwise(value), "nan1_12": F.when(value.isNull(), 1).when(value == 1, 2).otherwise(value), "nan_minus_1": F.coalesce(value, F.lit(-1)), "nan_half": F.coalesce(value.cast("double"), F.lit(0.5))}


def runs(rows: DataFrame, keys: tuple[str, ...], order: str, value: Column) -> DataFrame:
    """Maximal runs of equal, consecutive values: value, start, end (exclusive in rows of the order), n.  Null breaks runs and makes none."""
    v = rows.select(*keys, F.col(order).alias("_at"), value.alias("value"))
    w = Window.partitionBy(*keys).orderBy("_at")
    new = F.coalesce((F.lag("value").over(w) != F.col("value")) | F.lag("value").over(w).isNull() | F.col("value").isNull() | (F.lag("_at").over(w) != F.col("_at") - 1), F.lit(True))
    marked = v.withColumn("_new", new.cast("long")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    made = marked.where("value is not null").groupBy(*keys, "_run", "value").agg(F.min("_at").alias("start"), (F.max("_at") + 1).alias("end"), F.count("*").alias("n"))
    return made.drop("_run")


def run_lengths(rows: DataFrame, keys: tuple[str, ...], order: str, value: str) -> DataFrame:
    """Each row with the length of the run of ones that it is in, 0 outside."""
    w = track(keys, order)
    on = F.coalesce((F.col(value) == 1).cast("long"), F.lit(0))
    island = rows.withColumn("_on", on).withColumn("_island", F.sum(1 - F.col("_on")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum("_on").over(Window.partitionBy(*keys, "_island"))
    return island.withColumn("run_length", F.when(F.col("_on") == 1, n).otherwise(0)).drop("_on", "_island")


def merge_runs(intervals: DataFrame, keys: tuple[str, ...], gap: int, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals joined where the gap between one's end and the next one's start is at most `gap`: a session window over coordinates."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) - reach > gap, F.lit(True)).cast("long")
    marked = intervals.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_s").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_s")


def size_class(length: Column, classes: list[tuple[str, int, int | None]]) -> Column:
    """The first class with lo <= length < hi."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(classes):
        out = F.when((length >= lo) & (length < hi if hi is not None else F.lit(True)), name).otherwise(out)
    return out


def rolling_mean(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, window: int, least: int = 1) -> DataFrame:
    """Centred mean over `window // 2` rows on either side, ignoring nulls; null under `least` values."""
    half = window // 2
    w = track(keys, order).rowsBetween(-half, half)
    return rows.withColumn("rolling", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def spacing(intervals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sizes, centres and the distance to the next centre."""
    w = Window.partitionBy(*keys).orderBy("start")
    rows = intervals.withColumn("size", F.col("end") - F.col("start")).withColumn("centre", (F.col("start") + F.col("end") - 1) / 2)
    return rows.withColumn("to_next", F.lead("centre").over(w) - F.col("centre"))


def strand_switch(signs: DataFrame, keys: tuple[str, ...], order: str, sign: str) -> DataFrame:
    """Best purity of a split of each track in two by the majority sign of each side, and where; fewer than two marks give 1 and -1."""
    w = track(keys, order)
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    plus = (F.col(sign) > 0).cast("long")
    rows = signs.withColumn("_p", F.sum(plus).over(run)).withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole)).withColumn("_t", F.sum(plus).over(whole))
    left = F.greatest(F.col("_p"), F.col("_k") - F.col("_p"))
    right = F.greatest(F.col("_t") - F.col("_p"), (F.col("_n") - F.col("_k")) - (F.col("_t") - F.col("_p")))
    score = F.when((F.col("_k") < F.col("_n")), left + right)
    made = rows.withColumn("_s", score).groupBy(*keys).agg(F.first("_n").alias("n"), F.max("_s").alias("_best"), F.max_by("_k", F.struct("_s", -F.col("_k"))).alias("_at"), F.first("_t").alias("plus"))
    return made.select(*keys, "n", "plus", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.try_divide(F.col("_best").cast("double"), F.col("n"))).alias("purity"), F.when(F.col("n") < 2, F.lit(-1)).otherwise(F.col("_at")).cast("long").alias("split"))


def variant_segments(calls: DataFrame, keys: tuple[str, ...], position: str, call: str, least: int = 2) -> DataFrame:
    """Ordered site calls as segments of one member each, with breakpoints half way to the neighbour and support."""
    w = track(keys, position)
    rows = calls.where(F.col(call).isNotNull())
    new = F.coalesce(F.lag(call).over(w) != F.col(call), F.lit(True)).cast("long")
    marked = rows.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seg = marked.groupBy(*keys, "segment", F.col(call).alias("member")).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("sites"))
    s = Window.partitionBy(*keys).orderBy("segment")
    left = F.floor((F.lag("last").over(s) + F.col("first") + 1) / 2)
    right = F.floor((F.col("last") + F.lead("first").over(s) + 1) / 2)
    return seg.select(*keys, "segment", "member", "first", "last", "sites", F.coalesce(left, F.col("first")).alias("start"), F.coalesce(right, F.col("last") + 1).alias("end"), (F.col("sites") >= least).alias("supported"))


def mismatch_type(segments: DataFrame, keys: tuple[str, ...], home: int) -> DataFrame:
    """Where each track differs from its home member: none, all, left, right, middle or multi; and the run-length string of its segments."""
    made = segments.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("member") != home).cast("long")).alias("away"), F.min_by("member", "segment").alias("a"), F.max_by("member", "segment").alias("b"), F.array_sort(F.collect_list(F.struct("segment", "sites", "member"))).alias("all"))
    kind = F.when(F.col("away") == 0, "none").when((F.col("n") == 1), "all").when(F.col("away") > 1, "multi").when((F.col("a") != home) & (F.col("n") == 2), "left").when((F.col("b") != home) & (F.col("n") == 2), "right").when(F.col("n") == 3, "middle").otherwise("multi")
    return made.select(*keys, F.col("n").alias("segments"), kind.alias("mismatch"), F.array_join(F.transform("all", lambda x: F.concat(x["sites"].cast("string"), F.when(x["member"] == home, "H").otherwise("A"))), "").alias("program"))


def autocorrelation(calls: DataFrame, keys: tuple[str, ...], position: str, value: str, max_lag: int, pearson: bool = False) -> DataFrame:
    """Sum over pairs within max_lag of centred products, by lag, over the sum of squares (or by pair means); lag 0 is 1; tracks without variance are left out.

    A track is one row of arrays.  Tracks of a batch are paired together, each item with its next, second next
    and so on until none is within max_lag, so pairs are never rows and work is rows times max_lag at most.
    """
    kept = calls.where(F.col(value).isNotNull()).select(*keys, F.col(position).alias("p"), F.col(value).cast("double").alias("v"))
    kinds = dict(kept.dtypes)
    listed = kept.groupBy(*keys).agg(F.collect_list(F.struct("p", "v")).alias("a"))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, items = flat(batch["a"])
            p, x, n = numbers(items, "p", np.int64), numbers(items, "v"), np.bincount(at, minlength=len(batch))
            order = np.lexsort((p, at))
            at, p, x = at[order], p[order], x[order]
            x = x - (np.bincount(at, x, len(batch)) / np.maximum(n, 1))[at]
            ss = np.bincount(at, x * x, len(batch))
            usable = (n >= 2) & (ss > 1e-12)
            sums, pairs = np.zeros(len(batch) * (max_lag + 1)), np.zeros(len(batch) * (max_lag + 1), np.int64)
            i, d = np.flatnonzero(usable[at]), 0
            while len(i):
                d += 1
                i = i[i + d < len(at)]
                i = i[(at[i + d] == at[i]) & (p[i + d] - p[i] <= max_lag)]
                cell = at[i] * (max_lag + 1) + p[i + d] - p[i]
                sums += np.bincount(cell, x[i] * x[i + d], len(sums))
                pairs += np.bincount(cell, minlength=len(pairs))
            sums, pairs = sums.reshape(-1, max_lag + 1), pairs.reshape(-1, max_lag + 1)
            pairs[:, 0] = np.where(usable, n, 0)
            row, lag = np.nonzero(pairs)
            k = pairs[row, lag]
            ac = np.where(lag == 0, 1.0, (sums[row, lag] / k) / (ss[row] / n[row]) if pearson else sums[row, lag] / ss[row])
            place = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch[c].take(place) for c in keys], pa.array(lag).cast(items.field("p").type), pa.array(k), pa.array(ac)], [*keys, "lag", "pairs", "ac"])

    return listed.mapInArrow(paired, ", ".join(f"{c} {kinds[c]}" for c in keys) + f", lag {kinds['p']}, pairs long, ac double")


def sliding(rows: DataFrame, position: str, size: int, step: int, first: int, last: int) -> DataFrame:
    """Each row once for every window [start, start + size) of a grid of starts that holds it."""
    p = F.col(position)
    lo = F.greatest(F.lit(first), F.ceil((p - size + 1 - first) / step) * step + first)
    hi = F.least(F.floor((p - first) / step) * step + first, F.floor(F.lit((last - size - first) / step)) * step + first)
    starts = F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"), F.lit(step).cast("long")))
    return rows.withColumn("window_start", F.explode(starts))


def base_ranges(moves: DataFrame, keys: tuple[str, ...], at: str, move: str) -> DataFrame:
    """Sample ranges of bases from move flags: a base begins at each flag and lasts until the next."""
    w = track(keys, at)
    marked = moves.withColumn("base", F.sum(F.col(move).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("base > 0")


def window_autocorrelation(calls: DataFrame, group: tuple[str, ...], molecule: str, position: str, value: str, *, size: int, step: int, first: int, last: int, max_lag: int, least: int = 10) -> DataFrame:
    """Mean autocorrelation by lag within each sliding window, weighted by pairs; windows with fewer than `least` usable molecules are left out."""
    keys = (*group, "window_start")
    ac = autocorrelation(sliding(calls, position, size, step, first, last), (*keys, molecule), position, value, max_lag, pearson=True)
    per = ac.groupBy(*keys, "lag").agg(F.sum("pairs").alias("weight"), (F.sum(F.col("ac") * F.col("pairs")) / F.sum("pairs")).alias("mean"), F.count("*").alias("_n"))
    # Every usable molecule has one row of lag 0.
    counted = per.withColumn("molecules", F.max(F.when(F.col("lag") == 0, F.col("_n"))).over(Window.partitionBy(*keys)))
    return counted.where(F.col("molecules") >= least).drop("_n")


def resampled_trace(bases: DataFrame, keys: tuple[str, ...], at: str, value: str, k: int, out: str = "trace") -> DataFrame:
    """Samples of each base drawn out linearly to k points, first and last kept; a base of one sample repeats it."""
    made = bases.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("p"), F.col(value).cast("double").alias("v")))).alias("_s"))

    def point(j: Column) -> Column:
        x = j * (F.size("_s") - 1) / F.lit(float(max(k - 1, 1)))
        lo = F.floor(x).cast("int")
        a, b = F.get("_s", lo)["v"], F.get("_s", F.least(lo + 1, F.size("_s") - 1))["v"]
        return a + (b - a) * (x - lo)

    return made.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), point).alias(out))
