"""Hidden Markov models of Bernoulli calls along reads: decoding, posteriors, expectation-maximisation.

Reads are independent, so decoding is one pass over reads, which step through positions together in padded blocks, and each round of fitting is one pass whose
expected counts are summed by Spark; only the parameters (a few dozen numbers) are on the driver.
Missing positions add nothing to the likelihood, and transitions are counted between observed neighbours only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ragged import flat, numbers

EPS = 1e-8
#: Padded positions of a block of reads.
CELLS = 250_000


@dataclass
class Model:
    """Start (k), transitions (bins x k x k), emissions (channels x k); gap bins split transitions by distance."""

    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray
    gaps: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, start, trans, emit, gaps=()) -> Model:
        t, e = np.asarray(trans, float), np.atleast_2d(np.asarray(emit, float))
        return cls(np.asarray(start, float), t if t.ndim == 3 else np.repeat(t[None], len(gaps) + 1, axis=0), e, list(gaps))

    def log_emission(self, obs: np.ndarray) -> np.ndarray:
        """(... x positions x k) from (... x positions x channels); NaN is missing."""
        seen = ~np.isnan(obs)
        o = np.where(seen, obs, 0.0)[..., None]
        each = o * np.log(self.emit + EPS) + (1 - o) * np.log1p(-self.emit + EPS)
        return (each * seen[..., None]).sum(axis=-2)

    def bins(self, coords: np.ndarray) -> np.ndarray:
        return np.digitize(np.diff(coords), self.gaps, right=True)

    def passes(self, r: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward tables in log space, and the log-likelihood of each read; all reads take a position at once."""
        b, t, bins = self.log_emission(r.obs), np.log(self.trans + EPS), self.bins(r.coords)
        alpha, beta = np.full(b.shape, -np.inf), np.zeros(b.shape)
        alpha[:, 0] = np.log(self.start + EPS) + b[:, 0]
        for i in range(1, b.shape[1]):
            m = r.alive[i]
            alpha[:m, i] = np.logaddexp.reduce(alpha[:m, i - 1, :, None] + t[bins[:m, i - 1]], axis=1) + b[:m, i]
        for i in range(b.shape[1] - 2, -1, -1):
            m = r.alive[i + 1]
            beta[:m, i] = np.logaddexp.reduce(t[bins[:m, i]] + (b[:m, i + 1] + beta[:m, i + 1])[:, None, :], axis=2)
        return alpha, beta, np.logaddexp.reduce(alpha[np.arange(len(b)), r.lengths - 1], axis=1)

    def posteriors(self, r: Block) -> np.ndarray:
        alpha, beta, ll = self.passes(r)
        return np.exp(alpha + beta - ll[:, None, None])

    def paths(self, r: Block) -> np.ndarray:
        """Viterbi states, reads x positions."""
        b, t, bins = self.log_emission(r.obs), np.log(self.trans + EPS), self.bins(r.coords)
        best, back = np.log(self.start + EPS) + b[:, 0], np.zeros(b.shape, np.int16)
        for i in range(1, b.shape[1]):
            m = r.alive[i]
            reach = best[:m, :, None] + t[bins[:m, i - 1]]
            back[:m, i] = reach.argmax(axis=1)
            best[:m] = reach.max(axis=1) + b[:m, i]
        now, out = best.argmax(axis=1), np.zeros(b.shape[:2], np.int64)
        for i in range(b.shape[1] - 1, -1, -1):
            m = r.alive[i]
            out[:m, i] = now[:m]
            now[:m] = back[np.arange(m), i, now[:m]]
        return out

    def posterior(self, obs: np.ndarray, coords: np.ndarray) -> np.ndarray:
        """Posteriors of one read."""
        return self.posteriors(Block.of([coords], [[x] for x in obs.T]))[0]

    def viterbi(self, obs: np.ndarray, coords: np.ndarray) -> np.ndarray:
        """States of one read."""
        return self.paths(Block.of([coords], [[x] for x in obs.T]))[0]

    def expected(self, r: Block) -> tuple[np.ndarray, ...]:
        """Start counts, transition counts, emission numerators and denominators, and the log-likelihood, summed over reads."""
        alpha, beta, ll = self.passes(r)
        gamma = np.exp(alpha + beta - ll[:, None, None])
        seen = ~np.isnan(r.obs)
        b, bins = self.log_emission(r.obs), self.bins(r.coords)
        trans = np.zeros_like(self.trans)
        any_seen = seen.any(axis=2)
        x, i = np.nonzero(any_seen[:, :-1] & any_seen[:, 1:])
        steps = np.exp(alpha[x, i][:, :, None] + np.log(self.trans + EPS)[bins[x, i]] + (b[x, i + 1] + beta[x, i + 1])[:, None, :] - ll[x][:, None, None])
        for g in range(len(trans)):
            trans[g] = steps[bins[x, i] == g].sum(axis=0)
        return gamma[:, 0].sum(axis=0), trans, np.einsum("rpc,rpk->ck", np.where(seen, r.obs, 0.0), gamma), np.einsum("rpc,rpk->ck", seen.astype(float), gamma), np.array([ll.sum()])


@dataclass
class Block:
    """Reads of like length, longest first and padded with NaN, so the reads that reach a position are the first alive[position]."""

    at: np.ndarray
    lengths: np.ndarray
    alive: np.ndarray
    coords: np.ndarray
    obs: np.ndarray

    @classmethod
    def of(cls, coords: list[np.ndarray], channels: list[list[np.ndarray]], at: np.ndarray | None = None) -> Block:
        """The reads `at`, given longest first; channels holds a list of reads for each channel."""
        at = np.arange(len(coords)) if at is None else at
        lengths = np.array([len(coords[i]) for i in at])
        valid = np.arange(lengths[0]) < lengths[:, None]
        made = cls(at, lengths, valid.sum(axis=0), np.zeros(valid.shape), np.full((*valid.shape, len(channels)), np.nan))
        made.coords[valid] = np.concatenate([np.asarray(coords[i], float) for i in at])
        for c, reads in enumerate(channels):
            made.obs[..., c][valid] = np.concatenate([np.asarray(reads[i], float) for i in at])
        return made


def blocks(coords: list[np.ndarray], channels: list[list[np.ndarray]]) -> Iterator[Block]:
    """All reads, in blocks of at most CELLS padded positions (or one read) and of lengths within a factor of two."""
    n = np.array([len(c) for c in coords], np.int64)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    while len(order):
        longest = n[order[0]]
        size = min(max(1, CELLS // longest), int(np.count_nonzero(2 * n[order] >= longest)))
        yield Block.of(coords, channels, order[:size])
        order = order[size:]


def _arrays(calls: DataFrame, key: str, position: str, channels: list[str], *by: str) -> DataFrame:
    """One row for each read: its positions and channel values in order."""
    item = F.struct(F.col(position).cast("double").alias("p"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(channels)])
    rows = calls.groupBy(key, *by).agg(F.array_sort(F.collect_list(item)).alias("a"))
    return rows.select(key, F.transform("a", lambda x: x["p"]).alias("p"), *[F.col(f"a.c{k}").alias(f"c{k}") for k in range(len(channels))], *by)


def _blocks(pdf: pd.DataFrame, channels: int) -> Iterator[Block]:
    return blocks(list(pdf.iloc[:, 1]), [list(pdf.iloc[:, 2 + j]) for j in range(channels)])


def decode(calls: DataFrame, model: Model, key: str = "read_id", position: str = "position", channels: tuple[str, ...] = ("call",), how: str = "marginal") -> DataFrame:
    """State and posterior of every position; `how` is marginal (posterior argmax) or viterbi.  Unobserved positions keep a state."""
    kinds, k = dict(calls.dtypes), len(channels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in _blocks(pdf, k):
                post = model.posteriors(r)
                state = post.argmax(axis=2) if how == "marginal" else model.paths(r)
                valid = np.arange(r.coords.shape[1]) < r.lengths[:, None]
                mass = np.take_along_axis(post, state[:, :, None], axis=2)[:, :, 0]
                yield pd.DataFrame({key: np.repeat(pdf.iloc[:, 0].to_numpy()[r.at], r.lengths), position: r.coords[valid].astype(np.int64), "state": state[valid], "posterior": mass[valid]})

    return _arrays(calls, key, position, list(channels)).mapInPandas(run, f"{key} {kinds[key]}, {position} long, state long, posterior double")


def _updated(now: Model, parts: list[np.ndarray], update: tuple[str, ...]) -> Model:
    start, trans, num, den = parts[0], parts[1].reshape(now.trans.shape), parts[2].reshape(now.emit.shape), parts[3].reshape(now.emit.shape)
    rows = trans.sum(axis=2, keepdims=True)
    return Model(start / start.sum() if "start" in update and start.sum() else now.start, np.where(rows > 0, (trans + EPS) / (rows + EPS * trans.shape[2]), now.trans) if "trans" in update else now.trans, (num + EPS) / (den + 2 * EPS) if "emit" in update else now.emit, now.gaps)


def fit_groups(calls: DataFrame, model: Model, group: str | None, key: str = "read_id", position: str = "position", channels: tuple[str, ...] = ("call",), *, rounds: int = 10, tol: float = 1e-4, update: tuple[str, ...] = ("start", "trans", "emit")) -> dict[object, tuple[Model, list[float]]]:
    """Expectation-maximisation of a model for each value of `group` (samples: a dimension), all in one pass a round, and their log-likelihoods; a settled model stays."""
    by = F.col(group).cast("string") if group else F.lit("")
    reads = _arrays(calls.withColumn("_by", by), key, position, list(channels), "_by").cache()
    k, made, open_ = len(channels), {}, None
    for _ in range(rounds):
        now = {g: m for g, (m, _) in made.items()}

        def run(batches: Iterator[pd.DataFrame], now: dict = now) -> Iterator[pd.DataFrame]:
            sums: dict[object, list[np.ndarray]] = {}
            for pdf in batches:
                for g, part in pdf.groupby("_by", dropna=False):
                    g = None if pd.isna(g) else g
                    for r in _blocks(part, k):
                        got = now.get(g, model).expected(r)
                        sums[g] = [a + b for a, b in zip(sums[g], got, strict=True)] if g in sums else list(got)
            if sums:
                yield pd.DataFrame([(g, i, j, float(v)) for g, arrays in sums.items() for i, a in enumerate(arrays) for j, v in enumerate(a.reshape(-1))], columns=["by", "part", "at", "value"])

        left = reads if open_ is None else reads.where(F.coalesce("_by", F.lit("\0")).isin([g if g is not None else "\0" for g in open_]))
        parts: dict[object, list[np.ndarray]] = {}
        for r in left.mapInPandas(run, "by string, part int, at int, value double").groupBy("by", "part", "at").agg(F.sum("value").alias("value")).collect():
            parts.setdefault(r["by"], [np.zeros(s) for s in (model.start.size, model.trans.size, model.emit.size, model.emit.size, 1)])[r["part"]][r["at"]] = r["value"]
        for g, sums in parts.items():
            history = [*(made[g][1] if g in made else []), float(sums[4][0])]
            made[g] = _updated(now.get(g, model), sums, update), history
        open_ = [g for g in parts if len(h := made[g][1]) < 2 or abs(h[-1] - h[-2]) >= tol * max(abs(h[-2]), 1)]
        if not open_:
            break
    reads.unpersist()
    return made


def fit(calls: DataFrame, model: Model, key: str = "read_id", position: str = "position", channels: tuple[str, ...] = ("call",), *, rounds: int = 10, tol: float = 1e-4, update: tuple[str, ...] = ("start", "trans", "emit")) -> tuple[Model, list[float]]:
    """One model of all reads; `update` freezes the rest (emissions alone adapt a shared model to one sample)."""
    return fit_groups(calls, model, None, key, position, channels, rounds=rounds, tol=tol, update=update).get("", (model, []))


def saved(model: Model) -> str:
    return json.dumps({"start": model.start.tolist(), "trans": model.trans.tolist(), "emit": model.emit.tolist(), "gaps": model.gaps})


def loaded(text: str) -> Model:
    raw = json.loads(text)
    return Model.of(raw["start"], raw["trans"], raw["emit"], raw["gaps"])


REGISTRY: dict[str, type] = {}


def register(name: str):
    """Put a model family under a name."""

    def put(made):
        REGISTRY[name] = made
        return made

    return put


@register("single")
def single(p_stay: float = 0.9, low: float = 0.1, high: float = 0.9) -> Model:
    return Model.of([0.5, 0.5], [[p_stay, 1 - p_stay], [1 - p_stay, p_stay]], [[low, high]])


@register("multi")
def multi(channels: int = 2, p_stay: float = 0.9, low: float = 0.1, high: float = 0.9) -> Model:
    return Model.of([0.5, 0.5], [[p_stay, 1 - p_stay], [1 - p_stay, p_stay]], [[low, high]] * channels)


@register("distance_binned")
def distance_binned(gaps: tuple[float, ...] = (2, 8), p_stay: float = 0.9) -> Model:
    stay = [max(0.5, p_stay - 0.1 * k) for k in range(len(gaps) + 1)]
    return Model.of([0.5, 0.5], [[[s, 1 - s], [1 - s, s]] for s in stay], [[0.1, 0.9]], gaps)


def refine_runs(start: int, end: int, left_free: int, right_free: int, hexamer: int = 120, octamer: int = 147, wiggle: int = 40) -> tuple[str, int, int] | None:
    """A protected run widened into its unobserved flanks, then a centred octamer if 147 bases fit, else a hexamer if 120 do."""
    a, b = start - min(left_free, wiggle), end + min(right_free, wiggle)
    for name, size in (("octamer", octamer), ("hexamer", hexamer)):
        if b - a >= size:
            mid = (start + end) // 2
            s = min(max(mid - size // 2, a), b - size)
            return name, s, s + size
    return None


def tile_large(start: int, end: int, taken: list[tuple[int, int]], size: int = 147, linker: int = 50, buffer: int = 30) -> list[tuple[int, int]]:
    """Greedy tiles of a large run, left to right, away from calls that exist."""
    out, at = [], start
    while at + size <= end:
        hit = [e for s, e in taken if at < e + buffer and s - buffer < at + size]
        if hit:
            at = max(hit) + buffer
            continue
        out.append((at, at + size))
        at += size + linker
    return out


def refine(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Refined calls and tiles of runs with columns start, end, left_free and right_free, by read.

    A read is one row of arrays, and the runs of a batch are refined together, as refine_runs and tile_large do
    one by one; only large runs near a call of their own read are tiled one at a time, against the calls there.
    """
    kinds = dict(runs.dtypes)
    octamer, hexamer, wiggle, linker, buffer = 147, 120, 40, 50, 30
    fields = ("start", "end", "left_free", "right_free")

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, items = flat(batch["a"])
            start, end, left, right = (numbers(items, c, np.int64) for c in fields)
            a, b, large = start - np.minimum(left, wiggle), end + np.minimum(right, wiggle), end - start >= 2 * octamer
            size = np.where(b - a >= octamer, octamer, np.where(b - a >= hexamer, hexamer, 0))
            at_s = np.minimum(np.maximum((start + end) // 2 - size // 2, a), b - size)
            call = np.flatnonzero(~large & (size > 0))
            call = call[np.lexsort((at_s[call], at[call]))]
            # Calls that a tile of a large run could touch; rows are told apart by an offset wider than all positions.
            big = np.flatnonzero(large)
            span = int(max(np.abs(start).max(initial=0), np.abs(end).max(initial=0))) * 2 + 1000
            first, last = (np.searchsorted(at_s[call] + at[call] * span, x + at[big] * span) for x in (start[big] - buffer - octamer, end[big] + buffer))
            free, near = big[first == last], [(i, f, z) for i, f, z in zip(big, first, last, strict=True) if f < z]
            n = (end[free] - start[free] - octamer) // (octamer + linker) + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            tiles = np.repeat(start[free], n) + step * (octamer + linker)
            slow = [(at[i], s, e) for i, f, z in near for s, e in tile_large(int(start[i]), int(end[i]), [(int(at_s[c]), int(at_s[c] + size[c])) for c in call[f:z]])]
            rows = np.concatenate([at[call], np.repeat(at[free], n), np.array([x[0] for x in slow], np.int64)])
            starts = np.concatenate([at_s[call], tiles, np.array([x[1] for x in slow], np.int64)])
            ends = np.concatenate([at_s[call] + size[call], tiles + octamer, np.array([x[2] for x in slow], np.int64)])
            names = np.concatenate([np.where(size[call] == octamer, "octamer", "hexamer"), np.full(len(tiles) + len(slow), "tile")])
            place = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*[batch[k].take(place) for k in keys], pa.array(names.tolist(), pa.string()), pa.array(starts), pa.array(ends)], [*keys, "kind", "start", "end"])

    listed = runs.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("a"))
    return listed.mapInArrow(refined, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", kind string, start long, end long")
