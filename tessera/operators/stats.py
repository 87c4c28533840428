"""Position statistics, association tests, periodicity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ragged import flat, numbers


def position_pairs(calls: DataFrame, group: tuple[str, ...], value: str = "call") -> DataFrame:
    """Co-observed calls of every ordered pair of positions of a read, counted: n11, n10, n01, n00 by (group, i, j).

    Rows of a read become one array first, so the pairs of a read are made in place and only the counts, which
    combine before the shuffle, travel.
    """
    seen = calls.where(F.col(value).isNotNull()).groupBy(*group, "read_id").agg(F.collect_list(F.struct(F.col("position").alias("p"), F.col(value).alias("v"))).alias("a"))
    left = seen.select(*group, "a", F.explode("a").alias("x"))
    pairs = left.select(*group, "x", F.explode("a").alias("y"))
    both = lambda u, v: F.sum(((F.col("x.v") == u) & (F.col("y.v") == v)).cast("long"))
    return pairs.groupBy(*group, F.col("x.p").alias("i"), F.col("y.p").alias("j")).agg(both(1, 1).alias("n11"), both(1, 0).alias("n10"), both(0, 1).alias("n01"), both(0, 0).alias("n00"))


def binary_covariance(t: DataFrame) -> Column:
    """Share of co-observed reads with both modified."""
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    return F.coalesce(F.try_divide(F.col("n11").cast("double"), n), F.lit(0.0))


def chi_squared(least: int = 10) -> Column:
    """2 x 2 chi-squared without correction; null for a degenerate table or under `least` reads."""
    a, b, c, d = (F.col(x).cast("double") for x in ("n11", "n10", "n01", "n00"))
    n = a + b + c + d
    margin = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when((n >= least) & (margin > 0), n * (a * d - b * c) * (a * d - b * c) / F.nullif(margin, F.lit(0.0)))


def relative_risk(least: int = 10) -> Column:
    """(a / (a + b)) / (c / (c + d)) where defined."""
    a, b, c, d = (F.col(x).cast("double") for x in ("n11", "n10", "n01", "n00"))
    return F.when((a + b + c + d >= least) & (a + b > 0) & (c + d > 0) & (c > 0), F.try_divide(F.try_divide(a, a + b), F.try_divide(c, c + d)))


def pearson_matrix(calls: DataFrame, group: tuple[str, ...], value: str = "call") -> DataFrame:
    """Correlations with each column centred by all its own observations, missing values as zero."""
    w = Window.partitionBy(*group, "position")
    x = calls.where(F.col(value).isNotNull()).select(*group, "read_id", "position", (F.col(value) - F.avg(value).over(w)).alias("x"))
    norms = x.groupBy(*group, "position").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    arr = x.groupBy(*group, "read_id").agg(F.collect_list(F.struct("position", "x")).alias("a"))
    pairs = arr.select(*group, "a", F.explode("a").alias("l")).select(*group, "l", F.explode("a").alias("r"))
    cov = pairs.groupBy(*group, F.col("l.position").alias("i"), F.col("r.position").alias("j")).agg(F.sum(F.col("l.x") * F.col("r.x")).alias("c"))
    ni = norms.select(*group, F.col("position").alias("i"), F.col("norm").alias("ni"))
    nj = norms.select(*group, F.col("position").alias("j"), F.col("norm").alias("nj"))
    made = cov.join(ni, [*group, "i"]).join(nj, [*group, "j"])
    return made.select(*group, "i", "j", F.try_divide(F.col("c"), F.col("ni") * F.col("nj")).alias("r"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: the mass of tables no likelier than this one."""
    n, r, k = a + b + c + d, a + b, a + c
    x = np.arange(max(0, r + k - n), min(r, k) + 1, dtype=float)
    # Masses from the ratios of neighbours, relative to this table's.
    steps = np.log((r - x[:-1]) * (k - x[:-1])) - np.log((x[:-1] + 1) * (n - r - k + x[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(logs - logs.max())
    return min(1.0, float(mass[mass <= mass[a - int(x[0])] * (1 + 1e-7)].sum() / mass.sum()))


def with_fisher(tables: DataFrame, out: str = "p") -> DataFrame:
    """tables with the p-value of (a, b, c, d)."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_exact(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype="float64")

    return tables.withColumn(out, run("a", "b", "c", "d"))


def benjamini_hochberg(rows: DataFrame, group: tuple[str, ...], p: str = "p", tie: str = "position", out: str = "q") -> DataFrame:
    """Adjusted p: p m / rank, the least of those at or above each rank, at most 1."""
    part = Window.partitionBy(*group)
    up = part.orderBy(p, tie)
    ranked = rows.withColumn("_k", F.row_number().over(up)).withColumn("_m", F.count(p).over(part))
    raw = F.col(p) * F.col("_m") / F.col("_k")
    return ranked.withColumn("_q", raw).withColumn(out, F.least(F.min("_q").over(part.orderBy(F.desc("_k"))), F.lit(1.0))).drop("_k", "_m", "_q")


def activity_risk(calls: DataFrame, active: Column, group: tuple[str, ...]) -> DataFrame:
    """Relative risk of activity given modification, by Bayes' rule, for each position; skipped where undefined."""
    rows = calls.where("call is not null").withColumn("_a", active.cast("int"))
    per = rows.groupBy(*group, "position").agg(F.sum(F.col("_a") * F.col("call")).alias("a"), F.sum((1 - F.col("_a")) * F.col("call")).alias("b"), F.sum(F.col("_a") * (1 - F.col("call"))).alias("c"), F.sum((1 - F.col("_a")) * (1 - F.col("call"))).alias("d"))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    p_m, p_a, p_m_a = (a + b) / n, (a + c) / n, F.try_divide(a, a + c)
    risk = F.try_divide(p_m_a * p_a / p_m, (1 - p_m_a) * p_a / (1 - p_m))
    ok = (F.col("b") > 0) & (F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0) & (F.col("a") + F.col("c") > 0)
    return per.where(ok).withColumn("risk", risk)


def random_fill(calls: DataFrame, group: tuple[str, ...], seed: int = 42) -> DataFrame:
    """Missing calls drawn by a seeded hash against the column's mean, the same on every run."""
    mean = F.avg("call").over(Window.partitionBy(*group))
    draw = ((F.col("read_id") * 7919 + F.col("position") * 104729 + seed) % 1000003) / 1000003
    return calls.withColumn("filled", F.coalesce("call", (draw < mean).cast("int")))


def lomb_scargle(rows: DataFrame, keys: tuple[str, ...], position: str, value: str, periods: range) -> DataFrame:
    """Power of each period by closed-form sums: y centred on its mean, the phase offset removed, power over the total sum of squares."""
    y = F.col("_y")
    base = rows.where(F.col(value).isNotNull()).select(*keys, F.col(position).cast("double").alias("_t"), F.col(value).cast("double").alias("_v"))
    base = base.withColumn("_y", F.col("_v") - F.avg("_v").over(Window.partitionBy(*keys)))
    arg = 2 * math.pi * F.col("_t") / F.col("period")
    grid = base.withColumn("period", F.explode(F.sequence(F.lit(periods.start), F.lit(periods.stop - 1), F.lit(periods.step))))
    s = grid.groupBy(*keys, "period").agg(F.count("*").alias("n"), F.sum(y * F.cos(arg)).alias("yc"), F.sum(y * F.sin(arg)).alias("ys"), F.sum(F.cos(arg) * F.cos(arg)).alias("cc"), F.sum(F.sin(arg) * F.sin(arg)).alias("ss"), F.sum(F.cos(arg) * F.sin(arg)).alias("cs"), F.sum(y * y).alias("yy"))
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    power = (F.col("yc") * F.col("yc") * F.col("ss") + F.col("ys") * F.col("ys") * F.col("cc") - 2 * F.col("yc") * F.col("ys") * F.col("cs"))
    return s.where("yy > 1e-12").select(*keys, "period", "n", F.when(F.abs(det) > 1e-9, F.try_divide(power, det * F.col("yy"))).alias("power"))


def spectrum(values: np.ndarray, pad: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power) of a centred, zero-padded series."""
    x = np.nan_to_num(np.asarray(values, float))
    n = len(x) * pad
    return np.fft.rfftfreq(n), np.abs(np.fft.rfft(x - x.mean(), n)) ** 2


def band_peak(freq: np.ndarray, power: np.ndarray, band: tuple[float, float], prominence: float = 0.05) -> dict[str, float]:
    """The strongest local peak of a period band with enough prominence, or the band's maximum; its width at half height in bases, and its ratio to the median background."""
    with np.errstate(divide="ignore"):
        period = np.where(freq > 0, 1 / np.maximum(freq, 1e-12), np.inf)
    idx = np.flatnonzero((period >= band[0]) & (period <= band[1]))
    if not len(idx):
        return {"period": math.nan, "power": math.nan, "width": math.nan, "snr": math.nan}
    p = power[idx]
    need = max(prominence * p.max(), 1e-12)
    best = -1
    for k in range(1, len(p) - 1):
        if p[k] > p[k - 1] and p[k] >= p[k + 1]:
            left, right = k, k
            while left > 0 and p[left - 1] <= p[k]:
                left -= 1
            while right < len(p) - 1 and p[right + 1] <= p[k]:
                right += 1
            if p[k] - max(p[left : k + 1].min(), p[k : right + 1].min()) >= need and (best < 0 or p[k] > p[best]):
                best = k
    peak = idx[best if best >= 0 else int(p.argmax())]
    half = power[peak] / 2
    lo, hi = peak, peak
    while lo > 0 and power[lo] > half:
        lo -= 1
    while hi < len(power) - 1 and power[hi] > half:
        hi += 1
    cross = lambda i, j: freq[i] + (freq[j] - freq[i]) * (half - power[i]) / (power[j] - power[i]) if power[j] != power[i] else freq[i]
    f_lo, f_hi = cross(lo, min(lo + 1, len(power) - 1)), cross(hi, max(hi - 1, 0))
    rest = np.delete(power, slice(max(0, peak - 5), peak + 6))
    background = np.median(rest) if len(rest) else 0.0
    return {"period": float(1 / freq[peak]), "power": float(power[peak]), "width": float(1 / f_lo - 1 / f_hi) if f_lo > 0 and f_hi > 0 else math.nan, "snr": float(power[peak] / background) if background > 0 else math.nan}


def periodicity(curves: DataFrame, keys: tuple[str, ...], lag: str, value: str, band: tuple[float, float], harmonics: int = 3) -> DataFrame:
    """Spectral peak of each mean autocorrelation curve and the decay of its harmonics; a curve is one row a lag, so a group is small."""
    schema = ", ".join([f"{k} string" for k in keys] + ["period double", "power double", "width double", "snr double", "decay double"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(lag)
        made = band_peak(*spectrum(pdf[value].to_numpy(float)), band)
        lags, heights = pdf[lag].to_numpy(float), pdf[value].to_numpy(float)
        decay = math.nan
        if made["period"] == made["period"]:
            at = [int(np.abs(lags - made["period"] * k).argmin()) for k in range(1, harmonics + 1) if made["period"] * k <= lags.max()]
            pts = [(lags[i], math.log(heights[i])) for i in at if heights[i] > 0]
            if len(pts) >= 2:
                decay = float(-np.polyfit([x for x, _ in pts], [y for _, y in pts], 1)[0])
        return pd.DataFrame([[*(str(pdf[k].iloc[0]) for k in keys), made["period"], made["power"], made["width"], made["snr"], decay]], columns=[*keys, "period", "power", "width", "snr", "decay"])

    return curves.groupBy(*keys).applyInPandas(one, schema)


def detrend(rows: DataFrame, keys: tuple[str, ...], position: str, value: str, degree: int = 2) -> DataFrame:
    """Each read's values minus a fitted polynomial of its positions; a read is one row of arrays, and reads of a batch are fitted together.

    Polynomials are orthogonal over the read's own positions (Forsythe's recurrence), so a fit is a projection
    for each degree, of which a read has at most as many as distinct positions less one.
    """
    kept = rows.where(F.col(value).isNotNull()).select(*keys, position, value)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, items = flat(batch["a"])
            x, rest, n = numbers(items, "p"), numbers(items, "v"), len(batch)
            total = lambda z: np.bincount(at, z, n)  # noqa: E731, B023
            ratio = lambda u, d: np.divide(u, d, out=np.zeros(n), where=d > 0)  # noqa: E731, B023
            order = np.lexsort((x, at))
            fresh = np.ones(len(x), bool)
            fresh[1:] = (np.diff(x[order]) != 0) | (np.diff(at[order]) != 0)
            most = np.minimum(degree, np.bincount(at[order][fresh], minlength=n) - 1)
            x = x - ratio(total(x), np.bincount(at, minlength=n).astype(float))[at]
            widest = np.zeros(n)
            np.maximum.at(widest, at, np.abs(x))
            x = x / np.maximum(widest, 1e-300)[at]
            before, now, norm_before = np.zeros(len(x)), np.ones(len(x)), np.zeros(n)
            for j in range(degree + 1):
                norm = total(now * now)
                rest = rest - np.where(most >= j, ratio(total(rest * now), norm), 0.0)[at] * now
                turn = (x - ratio(total(x * now * now), norm)[at]) * now - ratio(norm, norm_before)[at] * before
                before, now, norm_before = now, turn, norm
            place = pa.array(at)
            yield pa.RecordBatch.from_arrays([*[batch[k].take(place) for k in keys], items.field("p"), items.field("v"), pa.array(rest)], [*keys, position, value, "detrended"])

    listed = kept.groupBy(*keys).agg(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v"))).alias("a"))
    return listed.mapInArrow(fitted, f"{', '.join(f'{n} {t}' for n, t in kept.dtypes)}, detrended double")


def needleman_wunsch(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> list[tuple[str, int, int, str, str]]:
    """Events of the global alignment (kind, place in a, place in b, letters); the diagonal wins ties, then up, then left."""
    n, m = len(a), len(b)
    score = [[gap * j for j in range(m + 1)]]
    for i in range(1, n + 1):
        above, row = score[-1], [gap * i]
        for j in range(1, m + 1):
            row.append(max(above[j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), above[j] + gap, row[j - 1] + gap))
        score.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                out.append(("substitution", i, j, a[i], b[j]))
        elif i and score[i][j] == score[i - 1][j] + gap:
            i -= 1
            out.append(("deletion", i, j, a[i], ""))
        else:
            j -= 1
            out.append(("insertion", i, j, "", b[j]))
    return out[::-1]


def mismatch_events(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Alignment events of two sequence columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(k, *e) for k, x, y in zip(pdf[key], pdf[a], pdf[b], strict=True) if x is not None and y is not None for e in needleman_wunsch(x, y)]
            yield pd.DataFrame(got, columns=[key, "kind", "at_a", "at_b", "base_a", "base_b"])

    return rows.select(key, a, b).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, kind string, at_a long, at_b long, base_a string, base_b string")


def change_points(signs: list[int], penalty: float, least: int = 3, efficiency: float = 0.9, error: float = 0.05) -> list[tuple[int, int, int]]:
    """Segments (start, end, strand) of a series of strand marks (+1, -1) by optimal partitioning with pruning; equal neighbours are merged."""
    n = len(signs)
    plus = np.concatenate([[0], np.cumsum([s > 0 for s in signs])])
    good, bad = math.log(efficiency), math.log(error)

    def cost(i: int, j: int) -> tuple[float, int]:
        p = int(plus[j] - plus[i])
        q = j - i - p
        up, down = -(p * good + q * bad), -(q * good + p * bad)
        return (up, 1) if up <= down else (down, -1)

    best, last, open_ = [0.0] + [math.inf] * n, [0] * (n + 1), [0]
    for j in range(1, n + 1):
        tried = []
        for i in open_:
            if j - i >= least or (i == 0 and j == n):
                v = best[i] + cost(i, j)[0] + (penalty if i else 0.0)
                tried.append((v, i))
                if v < best[j]:
                    best[j], last[j] = v, i
        worst = {i for v, i in tried if v > best[j] + penalty}
        open_ = [i for i in open_ if i not in worst] + ([j] if best[j] < math.inf else [])
    out, j = [], n
    while j > 0:
        i = last[j]
        out.append((i, j, cost(i, j)[1]))
        j = i
    merged: list[tuple[int, int, int]] = []
    for s in out[::-1]:
        if merged and merged[-1][2] == s[2]:
            merged[-1] = (merged[-1][0], s[1], s[2])
        else:
            merged.append(s)
    return merged


def strand_segments(marks: DataFrame, key: str, position: str, sign: str, scale: float = 3.0) -> DataFrame:
    """Change-point segments of each read's marks, penalty `scale` times the log of their number."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position)
        at = pdf[position].to_numpy()
        seg = change_points(pdf[sign].tolist(), scale * math.log(max(2, len(pdf))))
        return pd.DataFrame([(pdf[key].iloc[0], k, int(at[i]), int(at[j - 1]), j - i, s, len(seg) > 1) for k, (i, j, s) in enumerate(seg)], columns=[key, "segment", "first", "last", "marks", "strand", "chimeric"])

    kept = marks.where(F.col(sign).isNotNull()).select(key, position, sign)
    return kept.groupBy(key).applyInPandas(one, f"{key} {dict(marks.dtypes)[key]}, segment long, first long, last long, marks long, strand long, chimeric boolean")
