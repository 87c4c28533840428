"""Position statistics and periodicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import islands, qc, stats
from tessera.plans.registry import Tables, query

GROUP = ("reference", "sample")
PAIRS = """(SELECT x.reference, x.sample, x.position AS i, y.position AS j, count(*) FILTER (x.call = 1 AND y.call = 1) AS n11, count(*) FILTER (x.call = 1 AND y.call = 0) AS n10, count(*) FILTER (x.call = 0 AND y.call = 1) AS n01, count(*) FILTER (x.call = 0 AND y.call = 0) AS n00
FROM $calls x JOIN $calls y ON x.read_id = y.read_id WHERE x.call IS NOT NULL AND y.call IS NOT NULL GROUP BY 1, 2, 3, 4)"""
A, B, C, D = (f"CAST({x} AS DOUBLE)" for x in ("n11", "n10", "n01", "n00"))


@query(f"SELECT reference, sample, i, j, round(n11 / CAST(n11 + n10 + n01 + n00 AS DOUBLE), 9) AS covariance FROM {PAIRS}")
def stat_binary_covariance(t: Tables):
    made = stats.position_pairs(t.calls, GROUP)
    return made.select(*GROUP, "i", "j", F.round(stats.binary_covariance(made), 9).alias("covariance"))


@query(f"SELECT reference, sample, i, j, CASE WHEN n11 + n10 + n01 + n00 >= 10 AND (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00) > 0 THEN round((n11 + n10 + n01 + n00) * pow({A} * {D} - {B} * {C}, 2) / (({A} + {B}) * ({C} + {D}) * ({A} + {C}) * ({B} + {D})), 6) END AS chi2 FROM {PAIRS}")
def stat_chi_squared(t: Tables):
    return stats.position_pairs(t.calls, GROUP).select(*GROUP, "i", "j", F.round(stats.chi_squared(), 6).alias("chi2"))


@query(f"SELECT reference, sample, i, j, CASE WHEN n11 + n10 + n01 + n00 >= 10 AND n11 + n10 > 0 AND n01 + n00 > 0 AND n01 > 0 THEN round(({A} / ({A} + {B})) / ({C} / ({C} + {D})), 6) END AS risk FROM {PAIRS}")
def stat_relative_risk(t: Tables):
    return stats.position_pairs(t.calls, GROUP).select(*GROUP, "i", "j", F.round(stats.relative_risk(), 6).alias("risk"))


@query("""WITH c AS (SELECT reference, read_id, position, call - avg(call) OVER (PARTITION BY reference, position) AS x FROM $calls WHERE call IS NOT NULL), n AS (SELECT reference, position, sqrt(sum(x * x)) AS norm FROM c GROUP BY 1, 2)
SELECT a.reference, a.position AS i, b.position AS j, round(sum(a.x * b.x) / (max(p.norm) * max(q.norm)), 6) AS r FROM c a JOIN c b ON a.read_id = b.read_id AND a.reference = b.reference JOIN n p ON p.reference = a.reference AND p.position = a.position JOIN n q ON q.reference = b.reference AND q.position = b.position GROUP BY 1, 2, 3""")
def stat_pearson_matrix(t: Tables):
    return stats.pearson_matrix(t.calls, ("reference",)).withColumn("r", F.round("r", 6))


ACTIVITY = """(SELECT reference, position, CAST(sum(act * call) AS BIGINT) AS a, CAST(sum((1 - act) * call) AS BIGINT) AS b, CAST(sum(act * (1 - call)) AS BIGINT) AS c, CAST(sum((1 - act) * (1 - call)) AS BIGINT) AS d FROM (SELECT *, CASE WHEN read_id % 3 = 0 THEN 1 ELSE 0 END AS act FROM $calls WHERE call IS NOT NULL) GROUP BY 1, 2)"""


@query(f"SELECT reference, position, a, b, c, d, round(((a / CAST(a + c AS DOUBLE)) * ((a + c) / CAST(n AS DOUBLE)) / ((a + b) / CAST(n AS DOUBLE))) / nullif((1 - a / CAST(a + c AS DOUBLE)) * ((a + c) / CAST(n AS DOUBLE)) / (1 - (a + b) / CAST(n AS DOUBLE)), 0), 6) AS risk FROM (SELECT *, a + b + c + d AS n FROM {ACTIVITY}) WHERE b > 0 AND a + b > 0 AND c + d > 0 AND a + c > 0")
def stat_activity_risk(t: Tables):
    return stats.activity_risk(t.calls, F.col("read_id") % 3 == 0, ("reference",)).withColumn("risk", F.round("risk", 6))


FISHER = f"""(SELECT *, least(1.0, (SELECT sum(exp(m)) FROM (SELECT w - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1) AS m FROM (SELECT unnest(range(greatest(0, r + k - n), least(r, k) + 1)) AS x)) WHERE exp(m) <= exp(o) * (1 + 1e-7))) AS p FROM
(SELECT *, w - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS o FROM (SELECT *, lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) AS w FROM (SELECT *, a + b AS r, a + c AS k, a + b + c + d AS n FROM {ACTIVITY}) WHERE b > 0 AND a + b > 0 AND c + d > 0 AND a + c > 0)))"""


@query(f"""SELECT reference, position, round(p, 9) AS p, round(q, 9) AS q, round(log2(greatest((a / (a + c)) * ((a + c) / n) / ((a + b) / n) / nullif((1 - a / (a + c)) * ((a + c) / n) / (1 - (a + b) / n), 0), 1e-300)), 6) + 0.0 AS log2_risk, round(-log10(greatest(q, 1e-300)), 6) + 0.0 AS neg_log10_q
FROM (SELECT *, least(min(raw) OVER (PARTITION BY reference ORDER BY i DESC), 1.0) AS q FROM (SELECT *, p * count(*) OVER (PARTITION BY reference) / row_number() OVER (PARTITION BY reference ORDER BY p, position) AS raw, row_number() OVER (PARTITION BY reference ORDER BY p, position) AS i FROM {FISHER}))""")
def stat_activity_fisher(t: Tables):
    """Fisher p-values of the same tables with their adjusted values and log ratios."""
    rows = stats.with_fisher(stats.activity_risk(t.calls, F.col("read_id") % 3 == 0, ("reference",)))
    adjusted = stats.benjamini_hochberg(rows, ("reference",))
    return adjusted.select("reference", "position", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"), (F.round(F.log2(F.greatest("risk", F.lit(1e-300))), 6) + 0.0).alias("log2_risk"), (F.round(-F.log10(F.greatest("q", F.lit(1e-300))), 6) + 0.0).alias("neg_log10_q"))


@query("SELECT sample, position, p, least(min(raw) OVER (PARTITION BY sample ORDER BY k DESC), 1.0) AS q FROM (SELECT *, p * count(*) OVER (PARTITION BY sample) / row_number() OVER (PARTITION BY sample ORDER BY p, position) AS raw, row_number() OVER (PARTITION BY sample ORDER BY p, position) AS k FROM (SELECT c_mktsegment AS sample, c_custkey AS position, ((c_custkey * 7919) % 1000 + 1) / 1000.0::DOUBLE AS p FROM customer))".replace("least(min(raw) OVER (PARTITION BY sample ORDER BY k DESC), 1.0)", "round(least(min(raw) OVER (PARTITION BY sample ORDER BY k DESC), 1.0), 9)"))
def stat_benjamini_hochberg(t: Tables):
    rows = t.customer.select(F.col("c_mktsegment").alias("sample"), F.col("c_custkey").alias("position"), (((F.col("c_custkey") * 7919) % 1000 + 1) / F.lit(1000.0)).alias("p"))
    return stats.benjamini_hochberg(rows, ("sample",)).withColumn("q", F.round("q", 9))


@query("SELECT read_id, position, coalesce(call, CASE WHEN ((read_id * 7919 + position * 104729 + 42) % 1000003) / 1000003.0::DOUBLE < avg(call) OVER (PARTITION BY reference, position) THEN 1 ELSE 0 END) AS filled FROM $calls")
def stat_random_fill(t: Tables):
    return stats.random_fill(t.calls, ("reference", "position")).select("read_id", "position", "filled")


@query("""WITH b AS (SELECT reference, CAST(position AS DOUBLE) AS t, m - avg(m) OVER (PARTITION BY reference) AS y FROM (SELECT reference, position, avg(call) AS m FROM $calls WHERE call IS NOT NULL GROUP BY 1, 2)), g AS (SELECT reference, p.range AS period, y, 2 * pi() * t / p.range AS w FROM b, range(4, 31, 2) p),
s AS (SELECT reference, period, count(*) AS n, sum(y * cos(w)) AS yc, sum(y * sin(w)) AS ys, sum(cos(w) * cos(w)) AS cc, sum(sin(w) * sin(w)) AS ss, sum(cos(w) * sin(w)) AS cs, sum(y * y) AS yy FROM g GROUP BY 1, 2)
SELECT reference, CAST(period AS INT) AS period, n, round((yc * yc * ss + ys * ys * cc - 2 * yc * ys * cs) / ((cc * ss - cs * cs) * yy), 6) AS power FROM s""")
def stat_lomb_scargle(t: Tables):
    mean = t.calls.where("call is not null").groupBy("reference", "position").agg(F.avg("call").alias("m"))
    return stats.lomb_scargle(mean, ("reference",), "position", "m", range(4, 31, 2)).withColumn("power", F.round("power", 6))


@query()
def stat_periodicity(t: Tables):
    """Spectral peaks of mean autocorrelation curves; the numeric parts are tested on known waves."""
    ac = islands.autocorrelation(t.calls, ("sample", "read_id"), "position", "call", 40, pearson=True).where("lag > 0")
    return stats.periodicity(qc.weighted_mean(ac, ("sample", "lag"), "ac", "pairs"), ("sample",), "lag", "mean", (4, 30))


@query()
def stat_detrended_signal(t: Tables):
    """Signals less a quadratic of position, one read at a time; residual sums are tested against numpy."""
    return stats.detrend(t.calls, ("read_id",), "position", "signal", 2)


@query()
def stat_alignment_events(t: Tables):
    """Global alignment events between each segment and its mirror; tested against hand-worked alignments."""
    rows = t.segments.select("read_id", F.col("sequence").alias("a"), F.reverse("sequence").alias("b"))
    return stats.mismatch_events(rows, "read_id", "a", "b")


@query()
def stat_strand_change_points(t: Tables):
    """Penalised change points of each user's marks; tested against exhaustive search."""
    marks = t.track.where("call is not null").select("user_id", "position", (F.col("call") * 2 - 1).alias("sign"))
    return stats.strand_segments(marks, "user_id", "position", "sign")
