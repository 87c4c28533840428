"""Hand-worked examples and comparisons with slow, plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import cigar, sequences
from tessera.operators import dedup, hmm, islands, latent, ml, order, qc, select, stats, variants
from tessera.plans import catalog, workflow
from tessera.sources import adapters
from tessera.sources import tables


def plain_pairs(program, start):
    import re

    q, r, out = 0, start, []
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", program):
        n = int(n)
        if op in "M=X":
            out += [(q + i, r + i) for i in range(n)]
        q += n * (op in "MIS=X")
        r += n * (op in "MDN=X")
    return out, q, r - start


@pytest.mark.parametrize("parts", [1, 4])
def test_cigar_expansion(spark, parts):
    rng = random.Random(parts)
    rows = [(i, "".join(f"{rng.randint(1, 6)}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randint(1, 6))), rng.randint(0, 50)) for i in range(60)]
    df = spark.createDataFrame(rows, "read_id long, cigar string, reference_start long").repartition(parts)
    got = {}
    for r in cigar.aligned_pairs(df).collect():
        got.setdefault(r["read_id"], []).append((r["query_position"], r["position"]))
    sizes = {r[0]: r[1:] for r in df.select("read_id", cigar.query_length(F.col("cigar")), cigar.reference_length(F.col("cigar"))).collect()}
    for i, c, s in rows:
        pairs, q, r = plain_pairs(c, s)
        assert sorted(got.get(i, [])) == pairs and tuple(sizes[i]) == (q, r)


def test_segment_checks(spark):
    rows = [(1, "4M", "ACGT"), (2, "3M", "ACGT"), (3, "4Q", "ACGT"), (4, "4M", "ACGT"), (4, "4M", "ACGT"), (None, "1M", "A")]
    got = {r["read_id"]: r["reason"] for r in cigar.inconsistent(spark.createDataFrame(rows, "read_id long, cigar string, sequence string")).collect()}
    assert got == {2: "length_mismatch", 3: "malformed_cigar", 4: "duplicate_read_id", None: "missing_read_id"}


def test_identities_round_trip(spark):
    df = spark.createDataFrame([("exp/é+", "read?1"), ("a", "b")], "e string, r string")
    got = df.select("e", "r", sequences.split_pooled_name(sequences.pooled_name(F.col("e"), F.col("r"))).alias("x")).collect()
    assert all((g["x"]["experiment"], g["x"]["read"]) == (g["e"], g["r"]) for g in got)


def test_predicates_missing_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "k long, v double")
    ids = lambda t: [r[0] for r in df.where(select.predicate(t, df.columns)).orderBy("k").collect()]
    assert ids({"column": "v", "op": "ge", "value": 1.0}) == [1]
    assert ids({"column": "v", "op": "ge", "value": 1.0, "missing": "true"}) == [1, 2]
    assert ids({"column": "w", "op": "eq", "value": 1, "missing": "true"}) == [1, 2]
    assert ids({"not": {"any": [{"column": "v", "op": "is_null"}]}}) == [1]
    with pytest.raises(KeyError):
        select.predicate({"column": "w", "op": "eq", "value": 1}, df.columns)
    with pytest.raises(KeyError):
        select.scan_index(df, w=[1])
    with pytest.raises(ValueError):
        select.scan_index(df, start=1)


@pytest.mark.parametrize("width", [3, 64])
def test_interval_join_matches_all_pairs(spark, width):
    rng = random.Random(7)
    span = lambda: (lambda s: (s, s + rng.randint(0, 30)))(rng.randint(0, 200))
    a, b = [(i, *span()) for i in range(60)], [(i, *span()) for i in range(40)]
    left, right = spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, rs long, re long")
    got = sorted((r["i"], r["j"]) for r in select.interval_join(left, right, ("s", "e"), ("rs", "re"), bin_width=width).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] < y[2] and x[2] > y[1] and x[1] < x[2] and y[1] < y[2])


def test_runs_and_merges(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 1, 0, 1, None, 1, 1, 0, 0, 1])], "k long, position long, call int")
    got = sorted((r["start"], r["end"], r["value"]) for r in islands.runs(df, ("k",), "position", F.col("call")).collect())
    assert got == [(0, 2, 1), (2, 3, 0), (3, 4, 1), (5, 7, 1), (7, 9, 0), (9, 10, 1)]
    ones = islands.runs(df, ("k",), "position", F.col("call")).where("value = 1").select("k", "start", "end")
    assert sorted((r["start"], r["end"]) for r in islands.merge_runs(ones, ("k",), 1).collect()) == [(0, 7), (9, 10)]


def test_masked_hamming_and_neighbours(spark):
    rng = random.Random(5)
    base = [rng.choice([0, 1]) for _ in range(100)]
    rows, vectors = [], {}
    for i in range(40):
        v = [rng.choice([x, x, x, x, x, x, x, x, None, 1 - x]) if i % 2 else rng.choice([0, 1, None]) for x in base]
        vectors[i] = v
        rows += [("a", i, p, x) for p, x in enumerate(v)]
    calls = spark.createDataFrame(rows, "sample string, read_id long, position long, call int")

    def close(a, b):
        both = [(x, y) for x, y in zip(vectors[a], vectors[b], strict=True) if x is not None and y is not None]
        return len(both) >= 20 and sum(x != y for x, y in both) < 0.3 * len(both)

    got = {(r["a"], r["b"]) for r in dedup.near_duplicate_reads(calls, ("sample",), 100, window=50, least_overlap=20, threshold=0.3, passes=0).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(40), 2) if close(a, b)}


def test_components_of_a_path(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    got = dedup.connected(spark.range(n + 1).select(F.col("id").alias("node")), edges).collect()
    assert {r["component"] for r in got if r["node"] < n} == {0} and [r["component"] for r in got if r["node"] == n] == [n]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_a_long_path(spark, seed):
    n = 1000
    order = list(range(n))
    random.Random(seed).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    got = dedup.connected(spark.range(n).select(F.col("id").alias("node")), edges).collect()
    assert len(got) == n and {r["component"] for r in got} == {0}


def paths(model, obs, coords):
    k = len(model.start)
    b, t = model.log_emission(obs), np.log(model.trans + hmm.EPS)[model.bins(coords)]
    for p in itertools.product(range(k), repeat=len(obs)):
        yield p, math.log(model.start[p[0]] + hmm.EPS) + b[0, p[0]] + sum(t[i - 1, p[i - 1], p[i]] + b[i, p[i]] for i in range(1, len(p)))


@pytest.mark.parametrize("model", [hmm.single(0.8, 0.2, 0.7), hmm.Model.of([0.6, 0.4], [[[0.85, 0.15], [0.3, 0.7]], [[0.6, 0.4], [0.45, 0.55]]], [[0.15, 0.8]], (2,))])
def test_hmm_against_all_paths(model):
    obs = np.array([[1.0], [np.nan], [0.0], [1.0], [1.0], [0.0]])
    coords = np.array([0, 1, 5, 6, 20, 21.0])
    every = list(paths(model, obs, coords))
    assert tuple(model.viterbi(obs, coords)) == max(every, key=lambda x: x[1])[0]
    total = np.logaddexp.reduce([v for _, v in every])
    post = np.array([[np.exp(np.logaddexp.reduce([v for p, v in every if p[i] == s]) - total) for s in range(2)] for i in range(6)])
    assert np.allclose(model.posterior(obs, coords), post, atol=1e-6)


def test_hmm_blocks_are_read_by_read(monkeypatch):
    monkeypatch.setattr(hmm, "CELLS", 60)
    rng = np.random.default_rng(4)
    model = hmm.Model.of([0.6, 0.4], [[[0.85, 0.15], [0.3, 0.7]], [[0.6, 0.4], [0.45, 0.55]]], [[0.15, 0.8], [0.3, 0.6]], (2,))
    coords = [np.cumsum(rng.integers(1, 5, n)).astype(float) for n in (7, 1, 0, 30, 12, 80, 30, 2)]
    obs = [np.where(rng.random((len(c), 2)) < 0.3, np.nan, rng.integers(0, 2, (len(c), 2))) for c in coords]
    made = list(hmm.blocks(coords, [[o[:, c] for o in obs] for c in (0, 1)]))
    assert sorted(np.concatenate([r.at for r in made])) == [0, 1, 3, 4, 5, 6, 7] and len(made) > 2
    sums = [np.zeros(1)] * 5
    alone = [np.zeros(1)] * 5
    for r in made:
        sums = [a + b for a, b in zip(sums, model.expected(r), strict=True)]
        for row, i in enumerate(r.at):
            n = len(coords[i])
            assert np.array_equal(model.paths(r)[row, :n], model.viterbi(obs[i], coords[i]))
            assert np.allclose(model.posteriors(r)[row, :n], model.posterior(obs[i], coords[i]))
            alone = [a + b for a, b in zip(alone, model.expected(hmm.Block.of([coords[i]], [[x] for x in obs[i].T])), strict=True)]
    assert all(np.allclose(a, b) for a, b in zip(sums, alone, strict=True))


def test_hmm_groups_are_fitted_apart(spark):
    rows = [(r, p, "xy"[r % 2] if r % 5 else None, int((r * 7 + p * p) % (2 + r % 3) == 0)) for r in range(20) for p in range(12)]
    calls = spark.createDataFrame(rows, "read_id long, position long, sample string, call int")
    made = hmm.fit_groups(calls, hmm.single(0.8, 0.2, 0.8), "sample", rounds=2)
    assert set(made) == {"x", "y", None}
    for g, (model, history) in made.items():
        one, other = hmm.fit(calls.where("sample is null" if g is None else f"sample = '{g}'"), hmm.single(0.8, 0.2, 0.8), rounds=2)
        assert np.allclose(model.trans, one.trans) and np.allclose(model.emit, one.emit) and np.allclose(history, other)


def test_fisher_against_factorials():
    for a, b, c, d in [(0, 5, 5, 0), (3, 1, 2, 9), (1, 1, 1, 1), (12, 5, 7, 30), (0, 0, 4, 2), (0, 0, 0, 0)]:
        n, r, k = a + b + c + d, a + b, a + c
        mass = {x: math.comb(k, x) * math.comb(n - k, r - x) for x in range(max(0, r + k - n), min(r, k) + 1)}
        assert stats.fisher_exact(a, b, c, d) == pytest.approx(sum(m for m in mass.values() if m <= mass[a]) / sum(mass.values()))


def test_hmm_fit_raises_the_likelihood(spark):
    rng = np.random.default_rng(2)
    rows = []
    for r in range(40):
        s = 0
        for p in range(50):
            s = s if rng.random() < 0.9 else 1 - s
            if rng.random() < 0.8:
                rows.append((r, p, int(rng.random() < (0.85 if s else 0.1))))
    calls = spark.createDataFrame(rows, "read_id long, position long, call int")
    model, history = hmm.fit(calls, hmm.single(0.7, 0.3, 0.6), rounds=8)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:], strict=False)) and model.emit[0, 0] < 0.25 and model.emit[0, 1] > 0.7
    frozen, _ = hmm.fit(calls, model, rounds=1, update=("emit",))
    assert np.array_equal(frozen.trans, model.trans)


def test_refined_nucleosomes():
    assert hmm.refine_runs(100, 240, 10, 10) == ("octamer", 97, 244)
    assert hmm.refine_runs(100, 225, 0, 0)[0] == "hexamer" and hmm.refine_runs(100, 180, 5, 5) is None
    assert hmm.tile_large(0, 600, [(200, 300)]) == [(0, 147), (330, 477)]


def test_change_points_against_all_splits():
    rng = random.Random(9)
    for _ in range(30):
        signs = [rng.choice([1, 1, 1, -1]) if i < 8 else rng.choice([-1, -1, -1, 1]) for i in range(13)]
        penalty = 2.0
        good, bad = math.log(0.9), math.log(0.05)

        def cost(i, j, signs=signs):
            p = sum(s > 0 for s in signs[i:j])
            return min(-(p * good + (j - i - p) * bad), -((j - i - p) * good + p * bad))

        best = min(sum(cost(a, b) for a, b in itertools.pairwise((0, *cut, 13))) + penalty * len(cut) for n in range(4) for cut in itertools.combinations(range(1, 13), n) if all(b - a >= 3 for a, b in itertools.pairwise((0, *cut, 13))))
        seg = stats.change_points(signs, penalty)
        raw = sum(cost(a, b) for a, b, _ in seg) + penalty * (len(seg) - 1)
        assert raw <= best + 1e-9


def test_fisher_and_alignment():
    assert stats.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert stats.fisher_exact(10, 0, 0, 10) == pytest.approx(2 / math.comb(20, 10))
    assert stats.needleman_wunsch("ACGT", "ACGT") == []
    assert stats.needleman_wunsch("ACGT", "AGGT") == [("substitution", 1, 1, "C", "G")]
    assert stats.needleman_wunsch("ACGT", "AGT") == [("deletion", 1, 1, "C", "")]


def test_spectral_peak_of_a_wave():
    lags = np.arange(1000)
    made = stats.band_peak(*stats.spectrum(np.cos(2 * np.pi * lags / 180) * np.exp(-lags / 600)), (120, 260))
    assert abs(made["period"] - 180) < 4 and made["snr"] > 10


def test_lomb_scargle_peaks_at_the_period(spark):
    rows = [("r", p, math.sin(2 * math.pi * p / 25)) for p in range(0, 300, 3)]
    got = stats.lomb_scargle(spark.createDataFrame(rows, "k string, p long, v double"), ("k",), "p", "v", range(10, 61)).orderBy(F.desc("power")).first()
    assert got["period"] == 25 and got["power"] > 0.98


def test_saturation_inverts():
    c = 5000.0
    assert qc.saturation(c * -math.expm1(-3000 / c), 3000) == pytest.approx(c, rel=1e-6)


def test_grouped_factors_match_plain_updates(spark):
    rng = np.random.default_rng(4)
    x = (rng.random((40, 6)) < 0.5).astype(float)
    x[rng.random(x.shape) < 0.2] = np.nan
    calls = spark.createDataFrame([("ab"[i % 2], i, p, None if np.isnan(v) else int(v)) for i, row in enumerate(x) for p, v in enumerate(row)], "g string, read_id long, position long, call int").repartition(3)
    got = {r["read_id"]: r["weights"] for r in latent.grouped_nmf(calls, ("g",), 2, rounds=7, width=6, keep=3).collect()}
    start = spark.range(40).select("id", *[(F.pmod(F.xxhash64("id", F.lit(42), F.lit(i)), F.lit(1_000_003)) / 1_000_003.0 + 0.1) for i in range(2)]).orderBy("id").collect()
    for g in range(2):
        v, w, h = x[g::2], np.array([r[1:] for r in start])[g::2], np.random.default_rng(42).random((2, 6)) + 0.1
        seen, v = ~np.isnan(v), np.nan_to_num(v)
        for _ in range(7):
            h = h * (w.T @ v) / np.maximum(w.T @ (seen * (w @ h)), 1e-12)
            w = w * (v @ h.T) / np.maximum((seen * (w @ h)) @ h.T, 1e-12)
        assert np.allclose([got[i] for i in range(g, 40, 2)], w, rtol=1e-9)


def test_grouped_factors_take_bytes_and_no_shuffle_a_round(spark, monkeypatch):
    """Blocks of a few reads, fractions as well as marks, sums combined by a shuffle or not: the same weights; small whole values are stored as bytes."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (30, 5)).astype(float)
    x[rng.random(x.shape) < 0.3] = np.nan

    def weights(scale):
        calls = spark.createDataFrame([(None if i % 2 else "a", f"r{i}", p, None if np.isnan(v) else float(v) * scale) for i, row in enumerate(x) for p, v in enumerate(row)], "g string, read_id string, position long, call double")
        return {r["read_id"]: r["weights"] for r in latent.grouped_nmf(calls, ("g",), 2, rounds=5, keep=2).collect()}

    jobs, whole = [], latent.cut_lineage
    monkeypatch.setattr(latent, "cut_lineage", lambda df: jobs.append(dict(df.dtypes)) or whole(df))
    got = weights(1.0)
    assert all(d.get("x", "binary") == "binary" for d in jobs) and sum("x" in d for d in jobs) == 4
    monkeypatch.setattr(latent, "NMF_ROWS", 4)
    monkeypatch.setattr(latent, "SUMS_BYTES", 0)
    again = weights(1.0)
    half = weights(0.5)
    assert set(got) == set(again) == set(half) and all(np.allclose(got[k], again[k], rtol=1e-9) for k in got)
    seen = ~np.isnan(x)
    assert len(got) == int(seen.any(axis=1).sum()) and all(min(half[k]) >= 0 for k in half)


def test_every_read_has_a_part_in_the_factors(spark):
    """Reads after the 20,000th in hash order have a pattern of their own, which the factors must know."""
    order = [r[0] for r in spark.range(30_000).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(order[20_000:])
    reads = spark.createDataFrame([(i, [0, 0, 1, 1] if i in late else [1, 1, 0, 0]) for i in order], "read_id long, v array<int>")
    calls = reads.select(F.lit("r").alias("g"), "read_id", F.posexplode("v").alias("position", "call"))
    got = {r["read_id"]: max(r["weights"]) for r in latent.grouped_nmf(calls, ("g",), 2, rounds=8, width=4).collect()}
    assert len(got) == 30_000 and min(got[i] for i in late) > 1e-3


def test_neighbour_graph_recall_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(12, 6))[rng.integers(0, 12, 600)] * 2 + rng.normal(size=(600, 6)), 4)
    x[100:300] = x[100]  # a third of all rows in one place
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>").repartition(3)
    d = np.round(latent._distances(x, x), 9)
    np.fill_diagonal(d, np.inf)
    exact = [np.lexsort((np.arange(600), r))[:5].tolist() for r in d]

    def found():
        got = {}
        for r in sorted(latent.neighbour_graph(df, 5).collect(), key=lambda r: (r["q"], r["rank"])):
            got.setdefault(r["q"], []).append(r["p"])
        return got

    got = found()
    assert len(got) == 600 and all(got[i] == exact[i] for i in got)
    monkeypatch.setattr(latent, "LIST_ROWS", 30)
    monkeypatch.setattr(latent, "BLOCK_ROWS", 50)
    got = found()
    assert len(got) == 600 and np.mean([len(set(got[i]) & set(exact[i])) / 5 for i in got]) >= 0.9
    assert got[150] == exact[150] and len(set(map(tuple, got.values()))) > 300
    assert latent.neighbour_graph(df.limit(0), 5).count() == 0


def test_knn_in_blocks_and_partitions(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(latent, "QUERY_BYTES", 200)
    got = {}
    for r in latent.knn(df, df.where("vec_id % 20 = 0"), 3).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["p"]))
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [p for _, p in sorted(found)] == np.argsort(d)[:3].tolist()
    assert len(got) == 10


def test_factorisations_reduce_error():
    rng = np.random.default_rng(1)
    x = rng.random((30, 2)) @ rng.random((2, 12))
    w, h = latent.nmf(x, 2, 400)
    assert np.abs(x - w @ h).mean() < 0.02
    t = np.einsum("ir,jr,kr->ijk", *[rng.random((n, 2)) for n in (6, 5, 4)])
    f = latent.cp_decomposition(t, rng.random(t.shape) < 0.9, 2, 200)
    assert np.abs(np.einsum("ir,jr,kr->ijk", *f) - t).mean() < 0.05
    p = np.vstack([rng.normal(0, 0.3, (20, 3)), rng.normal(1.2, 0.3, (20, 3))])
    d = latent.diffusion_map(p, 1)[:, 0]
    assert (np.sign(d[:20]) == np.sign(d[0])).all() and np.sign(d[0]) != np.sign(d[25])


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = np.array([r["pca"] for r in latent.pca(df, "v", 2).orderBy("vec_id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for k in range(2):
        assert min(np.abs(got[:, k] - x @ vt[k]).max(), np.abs(got[:, k] + x @ vt[k]).max()) < 1e-8


def test_group_split_is_disjoint_and_near_its_shares(spark):
    rng = random.Random(2)
    rows = [(i, f"g{rng.randint(0, 39)}", rng.choice("aab")) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, g string, y string")
    made = ml.stratified_group_split(df, "g", "y", {"train": 0.7, "validation": 0.15, "test": 0.15}).cache()
    assert ml.leaking_groups(made, "g").count() == 0 and made.count() == 2000
    share = {r["role"]: r["n"] / 2000 for r in made.groupBy("role").agg(F.count("*").alias("n")).collect()}
    assert abs(share["train"] - 0.7) < 0.06 and min(share.values()) > 0.08


def test_planner_states_and_execution():
    ran = []
    p = catalog.Planner()
    for name, needs in (("raw", ()), ("pre", ("raw",)), ("hmm", ("pre",))):
        p.register(catalog.Node(name, needs), lambda name=name: ran.append(name))
    recorded = {}
    assert p.execute(["hmm"], recorded) == ["raw", "pre", "hmm"] == ran
    assert p.execute(["hmm"], recorded) == []
    p.register(catalog.Node("pre", ("raw",), version="2"), lambda: ran.append("pre2"))
    assert p.plan(["hmm"], recorded) == {"raw": "compatible", "pre": "stale_algorithm", "hmm": "dependent_recompute"}
    assert p.plan(["hmm"], recorded, {"raw"})["hmm"] == "blocked_missing_input"
    p.register(catalog.Node("raw", ("hmm",)))
    with pytest.raises(ValueError):
        p.order(["hmm"])


def test_text_sources(spark, tmp_path):
    (tmp_path / "r.bed").write_text("# c\nchr1\t10\t30\tx\nchr1\t90\t200\nchrZ\t1\t2\nchr1\t500\t600\n")
    lengths = spark.createDataFrame([("chr1", 100)], "reference string, length long")
    got = [(r["start"], r["stop"], r["name"]) for r in tables.read_bed(spark, f"file://{tmp_path}/r.bed", "plot", lengths).orderBy("start").collect()]
    assert got == [(10, 30, "x"), (90, 100, "plot:chr1:90-100")]
    (tmp_path / "r.fa").write_text(">chr1 first\nACgt\nAC\n>chr2\nTTTT\n")
    assert {r["reference"]: r["sequence"] for r in tables.read_fasta(spark, f"file://{tmp_path}/r.fa").collect()} == {"chr1": "ACGTAC", "chr2": "TTTT"}
    (tmp_path / "c.tsv").write_text("read_id\tchrom\tref_position\tcall_code\tcall_prob\nr1\tchr1\t5\tm\t0.9\nr1\tchr1\t6\t-\t0.9\nr2\tchr9\t6\tm\t0.5\n")
    got = [(r["position"], round(r["signal"], 6)) for r in tables.read_calls_tsv(spark, f"file://{tmp_path}/c.tsv", ["chr1"]).orderBy("position").collect()]
    assert got == [(5, 0.9), (6, 0.1)]
    assert tables.read_manifest(spark, f"file://{tmp_path}", "*.bed").count() == 1


def test_window_reads_overlap_and_prune(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    n = F.when(F.col("id") == 1, 3000).otherwise(5)
    rows = spark.range(1000).select((F.col("id") % 2).cast("string").alias("reference"), F.col("id").alias("read_id"), (F.col("id") * 10).alias("reference_start"), n.alias("n"))
    tables.write_store(rows, path, F.col("n"), 1000)
    df = tables.read_store(spark, path, "1", (2002, 2500)).select("read_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "start_bin" in plan.split("PartitionFilters")[1] and "LessThan(reference_start,2500)" in plan and "GreaterTha" in plan.split("PushedFilters")[1]
    # Read 1 is long and comes from far before the window; the read at 1990 to 1995 does not reach it.
    assert sorted(r[0] for r in df.collect()) == sorted([1, *(i for i in range(1000) if i % 2 and i * 10 < 2500 and i * 10 + 5 > 2002)])
    assert tables.read_store(spark, path).count() == 1000 and tables.read_store(spark, path, "1", (10_000, 10_001)).count() == 0


def test_points_in_spans_keep_repeated_rows(spark):
    points = spark.createDataFrame([("a", 5, "x"), ("a", 5, "x"), ("a", 9, "y"), ("b", 5, None), ("a", None, "z")], "k string, p long, extra string")
    spans = spark.createDataFrame([("a", 0, 7, "wide"), ("a", 4, 6, "inner"), ("b", 6, 9, "no"), ("a", 4, 6, "also")], "k string, s long, e long, v string")
    got = sorted(map(str, select.point_in_span(points, spans, "p", ("s", "e"), "v", "none", on=("k",), bin_width=4).select("k", "p", "extra", "v").collect()))
    assert got == sorted(f"Row(k={k!r}, p={p}, extra={x!r}, v={v!r})" for k, p, x, v in [("a", 5, "x", "inner"), ("a", 5, "x", "inner"), ("a", 9, "y", "none"), ("b", 5, None, "none"), ("a", None, "z", "none")])


def test_duplicate_reads_recall_with_copies(spark):
    """Production window and passes on groups with many copies: every pair that brute force links is in one cluster."""
    rng = random.Random(15)
    vectors = {}
    for g in range(30):
        base = [rng.choice([0, 1]) for _ in range(60)]
        for _ in range(rng.choice([1, 2, 4])):
            vectors[len(vectors)] = [rng.choice([x] * 24 + [1 - x, None]) for x in base]
    for _ in range(150):
        vectors[len(vectors)] = vectors[0]
    rows = [("s", i, p, x) for i, v in vectors.items() for p, x in enumerate(v)]
    got = {r["read_id"]: r for r in dedup.duplicate_reads(spark.createDataFrame(rows, "sample string, read_id long, position long, call int"), ("sample",), 60, threshold=0.2).collect()}
    linked = [(a, b) for a, b in itertools.combinations(vectors, 2) for both in [[(x, y) for x, y in zip(vectors[a], vectors[b], strict=True) if None not in (x, y)]] if len(both) >= 20 and sum(x != y for x, y in both) < 0.2 * len(both)]
    assert len(got) == len(vectors) and sum(got[a]["cluster"] == got[b]["cluster"] for a, b in linked) >= 0.98 * len(linked)
    assert got[0]["cluster_size"] >= 151 and not got[0]["is_duplicate"] and got[200]["is_duplicate"]
    pairs = set(linked)
    for r in got.values():
        assert r["cluster"] == r["read_id"] or any(r["read_id"] in p for p in pairs)


def test_leaf_order_keeps_blocks_together():
    rng = np.random.default_rng(3)
    block = rng.permutation(40) % 4
    vectors = np.eye(4)[block] * 10 + rng.normal(0, 0.1, (40, 4))
    order = latent.leaf_order(vectors)
    seen = block[order]
    assert sorted(order) == list(range(40)) and (seen[1:] != seen[:-1]).sum() == 3 and latent.leaf_order(vectors[:0]) == []


def test_workflow_is_taken_up_and_validated(spark, tmp_path):
    root, ran = f"file://{tmp_path}/flow", []
    flow = workflow.Workflow(spark, root)

    def make(name, n):
        return lambda w: ran.append(name) or spark.range(n)

    flow.add(catalog.Node("a"), make("a", 3))
    flow.add(catalog.Node("b", ("a",)), lambda w: ran.append("b") or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        flow.run(["b"])
    flow.made["b"] = make("b", 5)
    assert flow.run(["b"]) == {"a": "compatible", "b": "missing"} and ran == ["a", "b", "b"] and flow.validate() == []
    assert flow.run(["b"]) == {"a": "compatible", "b": "compatible"} and ran == ["a", "b", "b"]
    other = workflow.Workflow(spark, root)
    other.add(catalog.Node("a", version="2"), make("a", 3))
    assert sorted(other.validate()) == ["a: not what the plan makes", "b: not what the plan makes"]


def test_rebasecall_plans_are_frozen_as_accepted(spark, tmp_path):
    reads = spark.createDataFrame([(1,), (2,), (2,), (3,)], "read_id long")
    sources = spark.createDataFrame([(1, "f"), (1, "f"), (2, "f"), (2, "g")], "read_id long, source string")
    plan = workflow.rebasecall_plan(reads, sources)
    assert {r["read_id"]: (r["status"], r["source"]) for r in plan.collect()} == {1: ("ready", "f"), 2: ("ambiguous_source", None), 3: ("missing_source", None)}
    root = f"file://{tmp_path}/frozen"
    with pytest.raises(ValueError, match="accepted"):
        workflow.freeze(plan, root, "0")
    with pytest.raises(ValueError, match="source"):
        workflow.freeze(plan, root, workflow.plan_id(plan))
    ready = workflow.rebasecall_plan(reads.where("read_id = 1"), sources)
    assert workflow.plan_id(ready) == workflow.plan_id(ready.repartition(3))
    workflow.freeze(ready, root, workflow.plan_id(ready))
    assert tables.read_current(spark, root).count() == 1


def test_alignment_sources(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\nr1\t16\tchr1\t5\t60\t2S4M1D3M\t*\t0\t0\tACGTACGTA\t*\tNM:i:2\tCO:Z:a:b\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    rows = {r["read_id"]: r for r in adapters.get("sam").read(spark, f"file://{tmp_path}/x.sam").collect()}
    r = rows["r1"]
    assert (r["reference_start"], r["reference_end"], r["strand"], r["tags"], r["qualities"]) == (4, 12, "-", {"NM": "2", "CO": "a:b"}, None)
    assert (rows["r2"]["reference"], rows["r2"]["cigar"], rows["r2"]["is_mapped"], rows["r2"]["tags"]) == (None, None, False, {})
    with pytest.raises(KeyError):
        adapters.get("cram")


@pytest.mark.parametrize("family", ["logistic", "forest", "perceptron"])
def test_models_learn(spark, family):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame([(i, v, int(v[0] + v[1] > 0)) for i, v in rows], "i long, v array<double>, y int")
    got = ml.predict(ml.fit_model(df.where("i < 300"), "v", "y", family), df.where("i >= 300"), "v").collect()
    assert sum((r["score"] > 0.5) == (r["y"] == 1) for r in got) >= 80


def test_fuzzy_flanks(spark):
    rows = [("TTGACTACAAA",), ("TTGACACAAAA",), ("TTGAGCTACAA",), ("TTTTTTTT",), ("",), (None,), ("GA",)]
    got = [r["f"] and tuple(r["f"]) for r in spark.createDataFrame(rows, "s string").coalesce(1).select(sequences.fuzzy_find(F.col("s"), "GACTAC", 1).alias("f")).collect()]
    assert got == [(0, 2, 6), (1, 2, 5), (1, 2, 7), None, None, None, None]


def test_top_segments_skip_overlaps(spark):
    rows = [(1, 10, 0, 50), (1, 10, 0, 60), (1, 11, 10, 55), (1, 12, 58, 90), (1, 13, 200, 205), (1, 14, 100, 120), (2, 10, 5, 30)]
    df = spark.createDataFrame(rows, "read_id long, partner long, start long, end long")
    got = sorted((r["read_id"], r["rank"], r["partner"], r["start"], r["end"]) for r in variants.top_segments(df, "read_id", "partner", 3, 5, 10).collect())
    assert got == [(1, 1, 10, 0, 60), (1, 2, 12, 58, 90), (1, 3, 14, 100, 120), (2, 1, 10, 5, 30)]


def test_directional_clusters(spark):
    rows = [("s", "AAAA", 9), ("s", "AAAC", 3), ("s", "AACC", 2), ("s", "GGGG", 1), ("t", "AAAC", 1)]
    got = {(r["g"], r["u"]): r["centre"] for r in variants.directional_clusters(spark.createDataFrame(rows, "g string, u string, reads long"), ("g",), "u").collect()}
    assert got == {("s", "AAAA"): "AAAA", ("s", "AAAC"): "AAAA", ("s", "AACC"): "AACC", ("s", "GGGG"): "GGGG", ("t", "AAAC"): "AAAC"}


def test_global_rank_and_tiles(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(6)
    got = {r["k"]: r["rank"] for r in order.global_rank(df, "v", "k").collect()}
    assert [got[k] for k, _ in sorted(rows, key=lambda x: (x[1], x[0]))] == list(range(1, 501))
    tiles = spark.range(1, 24).select(order.tile(F.col("id"), F.lit(23), 5).alias("t")).groupBy("t").count().orderBy("t").collect()
    assert [r["count"] for r in tiles] == [5, 5, 5, 4, 4]


def test_registered_experiments(spark, tmp_path):
    from tessera.plans.projects import Projects

    p = Projects(spark, f"file://{tmp_path}/log")
    p.add("a", {"raw": "a0", "pre": "a1"})
    p.add("b", {"raw": "b0"})
    p.add("a", {"pre": "a2"})
    p.add("a", {"raw": "a9"}, lineage="redo")
    listed = lambda **k: sorted((r["experiment"], r["lineage"], r["stage"], r["path"]) for r in p.list(**k).collect())
    assert listed() == [("a", "original", "pre", "a2"), ("a", "original", "raw", "a0"), ("b", "original", "raw", "b0")]
    p.activate("a", "redo")
    p.remove("b")
    assert listed() == [("a", "redo", "raw", "a9")]
    assert listed(active_only=False)[-1] == ("b", "original", "raw", "b0")
    assert listed(lineage="original")[0] == ("a", "original", "pre", "a2")
    with pytest.raises(ValueError, match="no lineage redo: b"):
        p.list(active_only=False, lineage="redo")
    with pytest.raises(ValueError, match="no lineage third"):
        p.activate("a", "third")
    p.add("b", {"raw": "b1"})
    assert listed()[-1] == ("b", "original", "raw", "b1")


def test_training_plans():
    from tessera.plans.projects import training_plan

    raw = {"datasets": {"d": {"set": "s", "features": ["x"], "label": "y"}}, "splits": {"p": {"dataset": "d", "kind": "hash", "shares": {"train": 0.8, "test": 0.2}}}, "models": {"m": {"family": "forest", "settings": {"trees": 10, "depth": 3}}}, "jobs": {"j": {"split": "p", "model": "m"}}}
    plan, digest = training_plan(raw)
    assert plan["balancing"] == {} and training_plan(dict(reversed(raw.items())))[1] == digest
    over, other = training_plan(raw, {"models": {"m": {"settings": {"depth": 5}}}})
    assert over["models"]["m"]["settings"] == {"trees": 10, "depth": 5} and other != digest and raw["models"]["m"]["settings"]["depth"] == 3
    for bad, place in (({"more": {}}, "unknown sections"), ({"jobs": {"j": {"model": "n"}}}, "jobs.j.model"), ({"splits": {"p": {"kind": "odd"}}}, "splits.p.kind"), ({"splits": {"p": {"shares": {"train": 0.9}}}}, "splits.p.shares"), ({"datasets": {"d": {"experiments": ["e"]}}}, "datasets.d"), ({"models": {"m": {"colour": 1}}}, "models.m: unknown"), ({"models": {"n": {}}}, "models.n: fields missing")):
        with pytest.raises(ValueError, match=place):
            training_plan(raw, bad)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_sorted_neighbours_meet_across_blocks(spark, block):
    """Pairs within the window of a group's order, over block and group borders, against all pairs; no join makes candidates."""
    rng = random.Random(block)
    rows = [(rng.choice("ab") if i % 9 else None, i, rng.randrange(1 << 40), (1 << 63) - 1 - (1 << rng.randrange(60)), rng.randrange(1000)) for i in range(80)]
    df = spark.createDataFrame([(g, i, [b], [v], k) for g, i, b, v, k in rows], "g string, read_id long, bits array<long>, valid array<long>, k long").repartition(3)
    pairs = dedup.sorted_neighbours(df, ("g",), F.col("k"), "read_id", 1, 4, 20, 0.3, block)
    assert "SortMergeJoin" not in pairs._jdf.queryExecution().sparkPlan().toString()
    want = set()
    for g in "ab":
        order = sorted((k, i, b, v) for h, i, b, v, k in rows if h == g)
        for x, y in itertools.combinations(range(len(order)), 2):
            both = order[x][3] & order[y][3]
            differ = bin((order[x][2] ^ order[y][2]) & both).count("1")
            if y - x <= 4 and both.bit_count() >= 20 and differ < 0.3 * both.bit_count():
                want.add((*sorted((order[x][1], order[y][1])), differ, both.bit_count()))
    assert {tuple(r) for r in pairs.collect()} == want and want


@pytest.mark.parametrize("rows_of_block", [3, 10_000])
def test_rolling_neighbours_in_blocks(spark, monkeypatch, rows_of_block):
    """Patterns in blocks that all meet, a window beyond the 64th position too, against all pairs of reads."""
    monkeypatch.setattr(variants, "PATTERN_ROWS", rows_of_block)
    rng = random.Random(5)
    reads = {i: {p: rng.choice([0, 1, 1]) for p in range(80) if rng.random() < 0.6} for i in range(25)}
    reads[25], reads[26] = dict(reads[0]), {3: 1}
    calls = spark.createDataFrame([("g" if i % 3 else "h", i, p, c) for i, r in reads.items() for p, c in r.items()], "g string, read_id long, position long, call int")
    got = {(r["read_id"], r["start"]): r["distance"] for r in variants.rolling_neighbours(calls, ("g",), 80, 10, 10, 4).collect()}
    want = {}
    for i, j in itertools.permutations(reads, 2):
        for start in range(0, 80, 10):
            both = [p for p in range(start, start + 10) if p in reads[i] and p in reads[j]]
            if bool(i % 3) == bool(j % 3) and len(both) >= 4:
                want[i, start] = min(want.get((i, start), 1.0), sum(reads[i][p] != reads[j][p] for p in both) / len(both))
    assert got == want


def test_detrended_reads_of_a_batch_against_polyfit(spark):
    """Reads of one to thirty positions, some repeated, fitted together: each as by itself; no Python call for each read."""
    rng = np.random.default_rng(8)
    reads = {f"r{i}": (rng.integers(0, 1 + i * 40, 1 + i), rng.normal(size=1 + i)) for i in range(30)}
    df = spark.createDataFrame([(k, int(p), float(v)) for k, (x, y) in reads.items() for p, v in zip(x, y, strict=True)] + [("none", 1, None)], "read_id string, position long, signal double")
    made = stats.detrend(df, ("read_id",), "position", "signal")
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().sparkPlan().toString()
    got = {}
    for r in made.collect():
        got.setdefault(r["read_id"], []).append((r["position"], r["signal"], r["detrended"]))
    assert set(got) == set(reads)
    for k, (x, y) in reads.items():
        p, v, d = (np.array(c) for c in zip(*got[k], strict=True))
        assert sorted(zip(p, v, strict=True)) == sorted(zip(x.tolist(), y.tolist(), strict=True))
        q = p / max(1.0, np.abs(p).max())
        assert np.allclose(d, v - np.polyval(np.polyfit(q, v, min(2, len(set(x.tolist())) - 1)), q), atol=1e-8)


def test_refined_runs_of_a_batch(spark):
    """Runs refined together as one by one, with large runs near calls of their own read and of others."""
    rng = random.Random(10)
    runs = [(i % 7, s, s + rng.choice([50, 100, 130, 200, 290, 294, 600, 1500]), rng.randrange(60), rng.randrange(60)) for i in range(150) for s in [rng.randrange(4000)]]
    made = hmm.refine(spark.createDataFrame(runs, "read_id long, start long, end long, left_free long, right_free long").repartition(2), ("read_id",))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().sparkPlan().toString()
    want = []
    for read in range(7):
        own = [r[1:] for r in runs if r[0] == read]
        calls = [g for s, e, a, b in own if e - s < 294 and (g := hmm.refine_runs(s, e, a, b))]
        want += [(read, *c) for c in calls] + [(read, "tile", *t) for s, e, _, _ in own if e - s >= 294 for t in hmm.tile_large(s, e, [c[1:] for c in calls])]
    assert sorted(map(tuple, made.collect())) == sorted(want)


@pytest.mark.parametrize("pearson", [False, True])
def test_autocorrelation_pairs_are_no_rows(spark, pearson):
    """All pairs within the lag, repeated positions too (which once cut the pairs that a row could reach), against plain sums; no window or exploded pairs."""
    rng = random.Random(11)
    tracks = {f"t{i}": [(rng.randrange(12), rng.choice([0, 1, 1])) for _ in range(20)] for i in range(12)} | {"flat": [(1, 1), (2, 1)], "one": [(3, 1)]}
    df = spark.createDataFrame([(k, p, v) for k, t in tracks.items() for p, v in t] + [("one", 4, None)], "k string, position long, call int").repartition(3)
    made = islands.autocorrelation(df, ("k",), "position", "call", 5, pearson)
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    want = {}
    for k, t in tracks.items():
        mean = sum(v for _, v in t) / len(t)
        ss = sum((v - mean) ** 2 for _, v in t)
        if len(t) < 2 or ss <= 1e-12:
            continue
        want[k, 0] = (len(t), 1.0)
        for lag in range(1, 6):
            x = [(a - mean) * (b - mean) for p, a in t for q, b in t if q - p == lag]
            if x:
                want[k, lag] = (len(x), (sum(x) / len(x)) / (ss / len(t)) if pearson else sum(x) / ss)
    got = {(r["k"], r["lag"]): (r["pairs"], r["ac"]) for r in made.collect()}
    assert set(got) == set(want) and all(got[x][0] == want[x][0] and math.isclose(got[x][1], want[x][1], abs_tol=1e-9) for x in want)


def test_sequence_codes_at_the_edges(spark):
    """Empty, lower-case and unknown letters, flags with none or several set or a part of a base; no function of one element at a time."""
    s, f = F.col("s"), F.col("f")
    rows = [("", []), ("acgtnx-", [0, 0, 0, 0, 0]), ("A", [0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1]), (None, None), ("T\nG", [0, 0, 0, 0, 1, 0, 0, 0, 1, 0])]
    df = spark.createDataFrame(rows, "s string, f array<int>").select("s", sequences.encode(s).alias("c"), sequences.decode(sequences.encode(s)).alias("d"), F.size(sequences.one_hot(s)).alias("n"), sequences.one_hot_decode(sequences.one_hot(s)).alias("o"), sequences.one_hot_decode(f).alias("x"))
    assert "lambda" not in df._jdf.queryExecution().analyzed().toString()
    got = {r["s"]: r for r in df.collect()}
    assert [got["acgtnx-"][k] for k in "cdno"] == [[0, 1, 2, 3, 4, 4, 4], "ACGTNNN", 35, "ACGTNNN"] and got["T\nG"]["o"] == "TNG"
    assert [got[""][k] for k in "cdnox"] == [[], "", 0, "", ""] and [got[None][k] for k in "cdox"] == [None] * 4
    assert [got[k]["x"] for k in ("acgtnx-", "A", "T\nG")] == ["A", "CA", "NT"]
    for bad in (6, -1, 10):
        with pytest.raises(Exception, match="a base code is from 0 to 5"):
            spark.createDataFrame([([0, bad],)], "c array<tinyint>").select(sequences.decode(F.col("c"))).collect()


def test_hmm_blocks_hold_few_positions():
    """A batch of ten thousand reads of seventy positions takes blocks of at most a quarter of a million padded positions."""
    made = list(hmm.blocks([np.arange(70)] * 10_000, [[np.ones(70)] * 10_000] * 2))
    assert sum(len(r.at) for r in made) == 10_000 and max(r.coords.size for r in made) <= 250_000


def test_nearest_rows_with_ties_in_small_blocks(spark, monkeypatch):
    """Places of a coarse grid, so that rounding and ids decide; distances are held for a few queries at a time, and the result is that of a full sort."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (300, 4)) + rng.normal(0, 1e-11, (300, 4))
    held, whole = [], latent._distances
    monkeypatch.setattr(latent, "_distances", lambda a, b: held.append(len(a) * len(b)) or whole(a, b))
    ids = rng.permutation(300) * 3
    near, d = latent._least(x, ids, x, ids, 7)
    full = np.round(whole(x, x), 9)
    np.fill_diagonal(full, np.inf)
    best = np.lexsort((np.broadcast_to(ids, full.shape), full), axis=1)[:, :7]
    assert (near == ids[best]).all() and (d == np.take_along_axis(full, best, 1)).all()
    few = latent._least(x[:2], ids[:2], x[:5], ids[:5], 7)
    assert few[0].shape == (2, 5) and np.isinf(few[1]).sum() == 2
    monkeypatch.setattr(latent, "_distances", whole)
    monkeypatch.setattr(latent, "CELLS", 50)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in sorted(latent.knn(df, df, 7).collect(), key=lambda r: (r["q"], r["rank"])):
        got.setdefault(r["q"], []).append(r["p"])
    assert all(got[int(i)] == ids[b].tolist() for i, b in zip(ids, best, strict=True))
