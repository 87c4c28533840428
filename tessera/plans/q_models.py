"""Hidden Markov models, neighbours, clusters and factorisations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import hmm, islands, latent
from tessera.plans.registry import Tables, query


@query()
def hmm_viterbi(t: Tables):
    """Viterbi paths of each user's track; tested against enumeration of all paths."""
    return hmm.decode(t.track, hmm.single(), "user_id", how="viterbi")


@query()
def hmm_posterior(t: Tables):
    """Posterior states; tested against enumeration."""
    return hmm.decode(t.track, hmm.single(), "user_id").withColumn("posterior", F.round("posterior", 6))


@query()
def hmm_multi_channel(t: Tables):
    """Two channels, the second missing elsewhere."""
    rows = t.track.withColumn("other", F.when(F.col("position") % 3 == 0, (F.col("value") > 35).cast("int")))
    return hmm.decode(rows, hmm.multi(2), "user_id", channels=("call", "other"), how="viterbi")


@query()
def hmm_distance_binned(t: Tables):
    """Transitions by the gap to the last position of each read."""
    return hmm.decode(t.calls, hmm.distance_binned(), "read_id", how="viterbi")


@query()
def hmm_fit_em(t: Tables):
    """Parameters after four rounds of expectation-maximisation; the likelihood rises in the tests."""
    model, history = hmm.fit(t.calls, hmm.single(0.8, 0.2, 0.8), rounds=4)
    return t.spark.createDataFrame([(hmm.saved(model), len(history), round(history[-1], 3))], "model string, rounds int, log_likelihood double")


@query()
def hmm_adapt_emissions(t: Tables):
    """One shared model, emissions adapted to each sample."""
    shared, _ = hmm.fit(t.calls, hmm.single(0.8, 0.2, 0.8), rounds=2)
    adapted = hmm.fit_groups(t.calls, shared, "sample", rounds=2, update=("emit",))
    return t.spark.createDataFrame([(g, *[round(float(x), 6) for x in m.emit[0]]) for g, (m, _) in adapted.items()], "sample string, low double, high double")


@query()
def hmm_feature_segments(t: Tables):
    """Runs of the open state by size class, merged over small gaps: decoding and run operators together."""
    states = hmm.decode(t.track, hmm.single(), "user_id", how="viterbi")
    runs = islands.runs(states, ("user_id",), "position", F.col("state")).where("value = 1").select("user_id", "start", "end")
    merged = islands.merge_runs(runs, ("user_id",), 2)
    size = F.col("end") - F.col("start")
    return merged.withColumn("class", islands.size_class(size, [("short", 0, 4), ("medium", 4, 12), ("long", 12, None)]))


@query()
def hmm_refine_nucleosomes(t: Tables):
    """Protected runs refined to octamers, hexamers and tiles."""
    runs = t.orders.select((F.col("o_custkey")).alias("read_id"), (F.col("o_orderkey") % 5000).alias("start"), (F.col("o_orderkey") % 5000 + 60 + F.col("o_custkey") % 500).alias("end"), (F.col("o_orderkey") % 50).alias("left_free"), (F.col("o_custkey") % 50).alias("right_free"))
    return hmm.refine(runs, ("read_id",))


D = "(SELECT x.vec_id AS q, y.vec_id AS p, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))), 9) AS d, y.label FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0)"


@query(f"SELECT q, p, round(d, 5) AS d, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, p) AS rank FROM {D}) WHERE rank <= 10")
def latent_knn(t: Tables):
    found = latent.knn(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), 10)
    return found.withColumn("d", F.round("d", 5))


@query(f"SELECT q, label, confidence FROM (SELECT q, label, count(*) / 15.0::DOUBLE AS confidence, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, label) AS r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, p) AS rank FROM {D}) WHERE rank <= 15 GROUP BY 1, 2) WHERE r = 1")
def latent_transfer_labels(t: Tables):
    found = latent.knn(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), 15)
    return latent.transfer_labels(found, t.embeddings, 15)


@query()
def latent_connectivities(t: Tables):
    """Symmetric weights of the neighbour graph of all vectors."""
    return latent.connectivities(latent.neighbour_graph(t.embeddings, 15)).withColumn("w", F.round("w", 6))


@query()
def latent_communities(t: Tables):
    """Label propagation on the neighbour graph."""
    return latent.label_propagation(latent.connectivities(latent.neighbour_graph(t.embeddings, 15)), 5)


@query()
def latent_pca(t: Tables):
    """First three principal components; tested against numpy."""
    return latent.pca(t.embeddings, "embedding", 3).select("vec_id", *[F.round(F.col("pca")[i], 5).alias(f"pc{i}") for i in range(3)])


@query()
def latent_kmeans(t: Tables):
    """Three clusters, numbered by descending mean."""
    return latent.kmeans(t.embeddings, "embedding", 3)


@query()
def latent_nmf(t: Tables):
    """Non-negative weights of every read on factors of its reference."""
    return latent.grouped_nmf(t.calls, ("reference",), 3)


@query("""WITH n AS (SELECT count(DISTINCT read_id) AS n FROM $calls), c AS (SELECT position FROM $calls, n GROUP BY position, n.n HAVING count(call) >= 0.37 * n.n), k AS (SELECT * FROM $calls WHERE position IN (SELECT position FROM c))
SELECT read_id, position, call FROM k WHERE read_id IN (SELECT read_id FROM k GROUP BY 1 HAVING count(call) >= 0.3 * (SELECT count(*) FROM c))""")
def latent_coverage_filter(t: Tables):
    return latent.coverage_filter(t.calls, 0.37, 0.3).select("read_id", "position", "call")
