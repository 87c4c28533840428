"""Aggregations: coverage, read statistics, metrics, grouping sets, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import grid, qc
from tessera.plans.registry import Tables, query


def site():
    """Site types by turns along the positions."""
    return F.element_at(F.array(F.lit("GpC"), F.lit("CpG"), F.lit("other_C")), (F.col("position") % 3 + 1).cast("int"))


SITE_SQL = "CASE position % 3 WHEN 0 THEN 'GpC' WHEN 1 THEN 'CpG' ELSE 'other_C' END"


@query("""SELECT c.reference, position, count(call) AS valid_count, n_reads, round(count(call) / CAST(n_reads AS DOUBLE), 9) AS valid_fraction, count(call) / CAST(n_reads AS DOUBLE) >= 0.38 AS position_valid
FROM $calls c JOIN (SELECT reference, count(DISTINCT read_id) AS n_reads FROM $calls GROUP BY 1) r ON r.reference = c.reference GROUP BY 1, 2, 4""")
def agg_coverage(t: Tables):
    return qc.coverage(t.calls, 0.38).withColumn("valid_fraction", F.round("valid_fraction", 9))


@query("""SELECT reference, position, n_valid, modified, round(modified / CAST(n_valid AS DOUBLE), 9) AS fraction FROM (SELECT c.reference, c.position, count(call) AS n_valid, CAST(sum(call) AS BIGINT) AS modified FROM $calls c
JOIN (SELECT DISTINCT CAST(floor(o_orderkey / 8.0) AS BIGINT) AS read_id FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus = 'F') m ON m.read_id = c.read_id WHERE c.position >= 5 AND c.position < 45 GROUP BY 1, 2) WHERE n_valid >= 20""")
def agg_window_modification(t: Tables):
    """Coverage and modification of reads that pass quality control, in a window: the flagship."""
    passing = t.orders.where("o_totalprice >= 200000 and o_orderstatus = 'F'").select(F.floor(F.col("o_orderkey") / 8).cast("long").alias("read_id"))
    inside = t.calls.where("position >= 5 and position < 45").join(passing, "read_id", "left_semi")
    per = inside.groupBy("reference", "position").agg(F.count("call").alias("n_valid"), F.sum("call").alias("modified"))
    return per.where("n_valid >= 20").select("reference", "position", "n_valid", F.col("modified").cast("long").alias("modified"), F.round(qc.ratio(F.col("modified"), F.col("n_valid")), 9).alias("fraction"))


@query("SELECT reference, position, CAST(sum(valid) AS BIGINT) AS valid_count, CAST(sum(reads) AS BIGINT) AS n_rows, min(ctx) AS context FROM (SELECT reference, position, sample, count(call) AS valid, count(*) AS reads, min(sample) AS ctx FROM $calls GROUP BY 1, 2, 3) GROUP BY 1, 2")
def agg_partial_final(t: Tables):
    partial = t.calls.groupBy("reference", "position", "sample").agg(F.count("call").alias("valid"), F.count("*").alias("reads"))
    return partial.groupBy("reference", "position").agg(F.sum("valid").alias("valid_count"), F.sum("reads").alias("n_rows"), F.min("sample").alias("context"))


@query(f"SELECT read_id, {SITE_SQL} AS site_type, CAST(sum(call) AS BIGINT) AS modified, count(call) AS observed, CASE WHEN count(call) > 0 THEN round(sum(call) / CAST(count(call) AS DOUBLE), 9) END AS fraction FROM $calls GROUP BY 1, 2")
def agg_read_modification(t: Tables):
    return qc.read_modification(t.calls, site()).withColumn("fraction", F.round("fraction", 9))


@query(f"""WITH p AS (SELECT read_id, {SITE_SQL} AS s, sum(call) / CAST(nullif(count(call), 0) AS DOUBLE) AS f FROM $calls GROUP BY 1, 2), w AS (SELECT read_id, max(f) FILTER (s = 'GpC') AS g, max(f) FILTER (s = 'CpG') AS c, max(f) FILTER (s = 'other_C') AS o FROM p GROUP BY 1)
SELECT read_id, round(g, 9) AS "fraction_GpC", round(c, 9) AS "fraction_CpG", round(g / nullif(o, 0), 9) AS "GpC_to_other_C", round(c / nullif(o, 0), 9) AS "CpG_to_other_C" FROM w""")
def agg_background_ratios(t: Tables):
    wide = qc.background_ratios(qc.read_modification(t.calls, site()), ("GpC", "CpG"), "other_C")
    return wide.select("read_id", *[F.round(c, 9).alias(c) for c in wide.columns[1:]])


@query("SELECT read_id, min(position) AS first, max(position) AS last, max(position) - min(position) + 1 AS length FROM $calls WHERE call IS NOT NULL GROUP BY 1")
def agg_read_lengths(t: Tables):
    return qc.length_stats(t.calls)


@query("""SELECT reference, sample, CAST(sum(r) AS BIGINT) AS n_reads, CAST(sum(v) AS BIGINT) AS n_valid, CAST(sum(m) AS BIGINT) AS modified_sum, max(s) AS n_site_positions, round(sum(m) / CAST(sum(v) AS DOUBLE), 9) AS mean
FROM (SELECT reference, sample, CAST(floor(position / 20.0) AS BIGINT) AS core, count(DISTINCT read_id) AS r, count(call) AS v, sum(call) AS m, count(DISTINCT position) AS s FROM $calls GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def agg_merge_metrics(t: Tables):
    tasks = t.calls.groupBy("reference", "sample", F.floor(F.col("position") / 20).alias("core")).agg(F.count_distinct("read_id").alias("n_reads"), F.count("call").alias("n_valid"), F.sum("call").alias("modified_sum"), F.count_distinct("position").alias("n_site_positions"))
    return qc.merged_metrics(tasks, ("reference", "sample")).withColumn("mean", F.round("mean", 9))


@query("SELECT sample, position AS lag, CAST(sum(quality) AS DOUBLE) AS weight, CASE WHEN sum(quality) >= 3000 THEN round(sum(coalesce(call * quality, 0)) / sum(quality), 9) END AS mean FROM $calls GROUP BY 1, 2")
def agg_weighted_mean(t: Tables):
    return qc.weighted_mean(t.calls.withColumnRenamed("position", "lag"), ("sample", "lag"), "call", "quality", 3000).withColumn("mean", F.round("mean", 9))


@query("""SELECT reference, position, covered, mismatches, round(mismatches / CAST(covered AS DOUBLE), 9) AS frequency, round(mean_error, 9) AS mean_error, mismatches / CAST(covered AS DOUBLE) > mean_error AS variable
FROM (SELECT reference, position, count(*) AS covered, CAST(sum(mismatch) AS BIGINT) AS mismatches, avg(pow(10.0, -quality / 10)) AS mean_error FROM $calls GROUP BY 1, 2)""")
def agg_mismatch_frequency(t: Tables):
    return qc.mismatch_frequency(t.calls).withColumn("frequency", F.round("frequency", 9)).withColumn("mean_error", F.round("mean_error", 9))


@query("SELECT reference, position, round(avg(quality), 6) AS mean_quality, round(stddev_pop(quality), 6) AS std_quality, round(avg(pow(10.0, -quality / 10)), 6) AS mean_error, round(stddev_pop(pow(10.0, -quality / 10)), 6) AS std_error FROM $calls GROUP BY 1, 2")
def agg_quality_stats(t: Tables):
    made = qc.quality_stats(t.calls)
    return made.select("reference", "position", *[F.round(c, 6).alias(c) for c in made.columns[2:]])


BASE_SQL = "(SELECT l_partkey % 100 AS position, substr('ACGTN', CAST((l_suppkey + l_linenumber) % 5 + 1 AS INT), 1) AS base FROM lineitem)"


@query(f"SELECT position, max_by(base, n * 10 - instr('ACGTN', base)) AS consensus, max(n) AS support FROM (SELECT position, base, count(*) AS n FROM {BASE_SQL} GROUP BY 1, 2) GROUP BY 1")
def agg_consensus(t: Tables):
    rows = t.lineitem.select((F.col("l_partkey") % 100).alias("position"), F.substring(F.lit("ACGTN"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 5 + 1).cast("int"), F.lit(1)).alias("base"))
    return qc.consensus(rows, ("position",), "base")


@query(f"SELECT position, string_agg(base || ':' || CAST(round(n / CAST(total AS DOUBLE), 4) AS VARCHAR), ',' ORDER BY base) AS frequencies FROM (SELECT position, base, count(*) AS n, sum(count(*)) OVER (PARTITION BY position) AS total FROM {BASE_SQL} GROUP BY 1, 2) GROUP BY 1")
def agg_base_frequencies(t: Tables):
    rows = t.lineitem.select((F.col("l_partkey") % 100).alias("position"), F.substring(F.lit("ACGTN"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 5 + 1).cast("int"), F.lit(1)).alias("base"))
    n = rows.groupBy("position", "base").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("position")), 4)
    return n.withColumn("x", F.concat_ws(":", "base", share.cast("string"))).groupBy("position").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("frequencies"))


COHORT_SQL = """(SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'refA' ELSE 'refB' END AS reference, o_orderpriority AS sample, o_orderstatus <> 'P' AS passes, o_totalprice > 250000 AS dedup, o_custkey % 11 = 0 AS breakpoint, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 = 0 END AS duplicate FROM orders)"""


@query(f"""WITH x AS (SELECT * FROM {COHORT_SQL}), c AS (SELECT 'all' AS cohort, * FROM x UNION ALL SELECT 'passing', * FROM x WHERE passes UNION ALL SELECT 'passing_dedup', * FROM x WHERE passes AND dedup),
g AS (SELECT cohort, reference, sample, CASE grouping(reference, sample) WHEN 3 THEN 'overall' WHEN 1 THEN 'reference' WHEN 2 THEN 'sample' ELSE 'reference_sample' END AS scope, count(*) AS denominator, count(*) FILTER (breakpoint) AS b, count(*) FILTER (duplicate) AS d FROM c GROUP BY GROUPING SETS ((cohort), (cohort, reference), (cohort, sample), (cohort, reference, sample)))
SELECT cohort, scope, reference, sample, 'breakpoint' AS metric, b AS numerator, denominator, round(b / CAST(denominator AS DOUBLE), 9) AS rate FROM g UNION ALL SELECT cohort, scope, reference, sample, 'duplicate', d, denominator, round(d / CAST(denominator AS DOUBLE), 9) FROM g""")
def agg_cohort_grouping_sets(t: Tables):
    obs = t.orders.select(F.when(F.col("o_custkey") % 2 == 0, "refA").otherwise("refB").alias("reference"), F.col("o_orderpriority").alias("sample"), (F.col("o_orderstatus") != "P").alias("passes"), (F.col("o_totalprice") > 250000).alias("dedup"), (F.col("o_custkey") % 11 == 0).alias("breakpoint"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 5 == 0).alias("duplicate"))
    cohorts = {"all": F.lit(True), "passing": F.col("passes"), "passing_dedup": F.col("passes") & F.col("dedup")}
    made = qc.cohort_metrics(obs, cohorts, {"breakpoint": F.col("breakpoint"), "duplicate": F.col("duplicate")}, ("reference", "sample"))
    return made.withColumn("rate", F.round("rate", 9))


@query("SELECT reference, count(*) FILTER (sample = '1-URGENT') AS urgent, count(*) FILTER (sample = '2-HIGH') AS high, count(*) FILTER (sample = '5-LOW') AS low FROM $molecules GROUP BY 1")
def agg_pivot_counts(t: Tables):
    wide = t.molecules.groupBy("reference").pivot("sample", ["1-URGENT", "2-HIGH", "5-LOW"]).count()
    return wide.select("reference", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("5-LOW").alias("low"))


@query("""WITH r AS (SELECT o_orderpriority AS sample, o_custkey AS cluster, CAST(floor(CAST((o_orderkey * 7919 + 104729) % 1000003 AS DOUBLE) * 6 / 1000003) AS BIGINT) AS d FROM orders)
SELECT sample, k.range AS depth, count(*) AS reads, count(DISTINCT cluster) AS "unique" FROM r JOIN range(6) k ON r.d <= k.range GROUP BY 1, 2""")
def agg_complexity_curve(t: Tables):
    rows = t.orders.select(F.col("o_orderpriority").alias("sample"), F.col("o_custkey").alias("cluster"), "o_orderkey")
    return qc.complexity_curve(rows, ("sample",), "cluster", "o_orderkey", 6)


@query("""WITH e AS (SELECT sample, umi1, umi2, count(*) AS edges FROM $umis GROUP BY 1, 2, 3)
SELECT sample, umi1, umi2, edges, round(edges / CAST(sum(edges) OVER (PARTITION BY sample, umi1) AS DOUBLE), 9) AS fidelity_u, round(edges / CAST(sum(edges) OVER (PARTITION BY sample, umi2) AS DOUBLE), 9) AS fidelity_v,
row_number() OVER (PARTITION BY sample, umi1 ORDER BY edges DESC, umi2) = 1 AND row_number() OVER (PARTITION BY sample, umi2 ORDER BY edges DESC, umi1) = 1 AS mutual FROM e""")
def agg_umi_bipartite(t: Tables):
    made = qc.bipartite(t.umis, "umi1", "umi2", ("sample",))
    return made.withColumn("fidelity_u", F.round("fidelity_u", 9)).withColumn("fidelity_v", F.round("fidelity_v", 9))


AGREE_SQL = "(SELECT n_name AS a, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN ' Unclassified' WHEN c_custkey % 5 = 0 THEN 'nation_' || CAST(c_custkey % 25 AS VARCHAR) ELSE upper(n_name) || ' ' END AS b FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@query(f"""SELECT CASE WHEN x IS NULL AND y IS NULL THEN 'both_unclassified' WHEN y IS NULL THEN 'rederived_unclassified' WHEN x = y THEN 'agree' ELSE 'disagree' END AS agreement, count(*) AS n
FROM (SELECT lower(trim(a)) AS x, nullif(lower(trim(b)), 'unclassified') AS y FROM {AGREE_SQL}) GROUP BY 1""")
def agg_demux_agreement(t: Tables):
    return qc.agreement(_labels(t), "a", "b").groupBy("agreement").agg(F.count("*").alias("n"))


def _labels(t: Tables):
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    b = F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, " Unclassified").when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("nation_"), (F.col("c_custkey") % 25).cast("string"))).otherwise(F.concat(F.upper("n_name"), F.lit(" ")))
    return rows.select(F.col("n_name").alias("a"), b.alias("b"))


@query(f"SELECT lower(trim(a)) AS assigned, lower(trim(b)) AS rederived, count(*) AS n FROM {AGREE_SQL} WHERE lower(trim(a)) <> lower(trim(b)) AND lower(trim(b)) <> 'unclassified' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10")
def agg_confusion_pairs(t: Tables):
    wrong = qc.agreement(_labels(t), "a", "b").where("agreement = 'disagree'")
    pairs = wrong.groupBy(F.lower(F.trim("a")).alias("assigned"), F.lower(F.trim("b")).alias("rederived")).agg(F.count("*").alias("n"))
    return pairs.orderBy(F.desc("n"), "assigned", "rederived").limit(10)


@query("""SELECT o_custkey AS molecule, count(*) AS segment_count, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT ref) > 1 THEN 'discordant' WHEN count(*) = 2 THEN 'proper_pair' ELSE 'multiple' END AS pair_state, min(s) AS reference_start, max(s + 25) AS reference_end, count(DISTINCT ref) > 1 AS mixed_reference, arg_min(ref, s * 10000000 + o_orderkey) AS reference
FROM (SELECT o_custkey, o_orderkey, o_orderstatus AS ref, o_orderkey % 500 AS s FROM orders) GROUP BY 1""")
def agg_collapse_segments(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("molecule"), F.col("o_orderkey").alias("read_id"), F.col("o_orderstatus").alias("reference"), (F.col("o_orderkey") % 500).alias("reference_start"), (F.col("o_orderkey") % 500 + 25).alias("reference_end"))
    return grid.collapse_segments(rows)


@query("""WITH r AS (SELECT l_orderkey AS molecule, l_linenumber AS position, l_discount AS signal, l_quantity AS quality, substr('ACGT', CAST(l_suppkey % 4 + 1 AS INT), 1) AS base FROM lineitem), q AS (SELECT *, max(quality) OVER (PARTITION BY molecule, position) AS top FROM r)
SELECT molecule, position, count(signal) AS mates, CASE WHEN min(signal) = max(signal) THEN min(signal) END AS signal, min(signal) <> max(signal) AS conflict, CASE WHEN count(DISTINCT base) FILTER (quality = top) > 1 THEN 'N' ELSE max(base) FILTER (quality = top) END AS base FROM q GROUP BY 1, 2""")
def agg_paired_consensus(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("molecule"), F.col("l_linenumber").alias("position"), F.col("l_discount").alias("signal"), F.col("l_quantity").alias("quality"), F.substring(F.lit("ACGT"), (F.col("l_suppkey") % 4 + 1).cast("int"), F.lit(1)).alias("base"))
    return grid.paired_consensus(rows)


RESCUE_SQL = "(SELECT l_orderkey AS read_id, 'chr' || CAST(l_suppkey % 4 AS VARCHAR) AS chromosome, CAST(l_quantity * 20 AS BIGINT) AS length, l_linenumber = 1 AS is_primary FROM lineitem)"


@query(f"""WITH b AS (SELECT read_id, chromosome, max(length) AS length, bool_or(is_primary) AS is_primary FROM {RESCUE_SQL} GROUP BY 1, 2), p AS (SELECT read_id, arg_max(chromosome, length * 100 + CAST(substr(chromosome, 4) AS INT)) AS best, max(length) AS bl, max(length) FILTER (is_primary) AS pl, max(chromosome) FILTER (is_primary) AS "primary" FROM b GROUP BY 1)
SELECT read_id, "primary", best, bl - coalesce(pl, 0) AS gain, best <> coalesce("primary", '') AND bl - coalesce(pl, 0) >= 20 AND bl - coalesce(pl, 0) >= 0.01 * bl AS promote FROM p""")
def agg_alignment_rescue(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("read_id"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 4).cast("string")).alias("chromosome"), (F.col("l_quantity") * 20).cast("long").alias("length"), (F.col("l_linenumber") == 1).alias("is_primary"))
    return qc.rescue(rows)


@query("SELECT c_nationkey AS uid, count(DISTINCT c_mktsegment) AS names FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def agg_reference_conflicts(t: Tables):
    return t.customer.groupBy(F.col("c_nationkey").alias("uid")).agg(F.count_distinct("c_mktsegment").alias("names")).where("names > 1")


@query("SELECT reference, count(*) AS n_reads, count(*) * 600 * 4 AS estimated_bytes, CASE WHEN count(*) * 600 * 4 > 18000000 THEN 'tiled' ELSE 'full' END AS mode FROM $molecules GROUP BY 1")
def agg_plan_references(t: Tables):
    per = t.molecules.groupBy("reference").agg(F.count("*").alias("n_reads"))
    size = F.col("n_reads") * 600 * 4
    return per.select("reference", "n_reads", size.alias("estimated_bytes"), F.when(size > 18000000, "tiled").otherwise("full").alias("mode"))


@query("SELECT reference, round(avg(CASE WHEN chimera THEN 1.0 ELSE 0.0 END) FILTER (sample = '1-URGENT'), 9) AS urgent, round(avg(CASE WHEN chimera THEN 1.0 ELSE 0.0 END) FILTER (sample = '5-LOW'), 9) AS low FROM (SELECT reference, sample, read_id % 6 = 0 AS chimera FROM $molecules) GROUP BY 1")
def agg_chimera_rate(t: Tables):
    rows = t.molecules.withColumn("chimera", (F.col("read_id") % 6 == 0).cast("double"))
    wide = rows.groupBy("reference").pivot("sample", ["1-URGENT", "5-LOW"]).agg(F.avg("chimera"))
    return wide.select("reference", F.round("1-URGENT", 9).alias("urgent"), F.round("5-LOW", 9).alias("low"))


@query("SELECT label, bucket, n, round(n / CAST(sum(n) OVER (PARTITION BY bucket) AS DOUBLE), 9) AS share FROM (SELECT label, vec_id % 4 AS bucket, count(*) AS n FROM embeddings GROUP BY 1, 2 QUALIFY sum(count(*)) OVER (PARTITION BY bucket) >= 20)")
def agg_cluster_composition(t: Tables):
    n = t.embeddings.groupBy("label", (F.col("vec_id") % 4).alias("bucket")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("bucket"))
    return n.withColumn("t", total).where("t >= 20").select("label", "bucket", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


@query("SELECT coalesce(avg(value), 0) AS mean, stddev_pop(value) AS std, mode_value FROM (SELECT round(value, 1) AS value, (SELECT v FROM (SELECT round(value, 0) AS v, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, v LIMIT 1)) AS mode_value FROM events) GROUP BY mode_value".replace("coalesce(avg(value), 0) AS mean, stddev_pop(value) AS std", "round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std"))
def agg_moments_and_mode(t: Tables):
    mode = t.events.groupBy(F.round("value", 0).alias("v")).agg(F.count("*").alias("n")).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode_value"))
    return t.events.agg(F.round(F.avg(F.round("value", 1)), 6).alias("mean"), F.round(F.stddev_pop(F.round("value", 1)), 6).alias("std")).crossJoin(F.broadcast(mode))


@query("SELECT bucket, count(*) AS n FROM (SELECT CAST(least(floor(quality / 5), 9) AS BIGINT) AS bucket FROM $calls) GROUP BY 1")
def agg_quality_histogram(t: Tables):
    return t.calls.groupBy(F.least(F.floor(F.col("quality") / 5), F.lit(9)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 9) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2")
def agg_pricing_summary(t: Tables):
    return t.lineitem.where("l_shipdate <= timestamp_ntz '2001-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT reference, position, signal, sample = 'bc01' AS pos FROM $calls WHERE sample IN ('bc01', 'bc02')), d AS (SELECT reference, position, signal, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM s GROUP BY 1, 2, 3),
r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY reference, position) AS tot_p, sum(n) OVER (PARTITION BY reference, position) AS tot_n FROM d WINDOW w AS (PARTITION BY reference, position ORDER BY signal DESC ROWS UNBOUNDED PRECEDING)),
j AS (SELECT *, round(tp / CAST(tot_p AS DOUBLE) - fp / CAST(tot_n AS DOUBLE), 12) AS j FROM r WHERE tot_p > 0 AND tot_n > 0), b AS (SELECT *, row_number() OVER (PARTITION BY reference, position ORDER BY j DESC, signal DESC) AS k FROM j)
SELECT reference, position, signal AS threshold, round(j, 9) AS j, CAST(tot_p AS BIGINT) AS positives, CAST(tot_n AS BIGINT) AS negatives FROM b WHERE k = 1""")
def agg_position_youden(t: Tables):
    rows = t.calls.where("sample in ('bc01', 'bc02')").withColumn("positive", F.col("sample") == "bc01")
    return qc.youden(rows, ("reference", "position"), "signal", "positive").withColumn("j", F.round("j", 9))


@query("""SELECT reference, start, "end", depth FROM (SELECT reference, p AS start, lead(p) OVER (PARTITION BY reference ORDER BY p) AS "end", CAST(sum(d) OVER (PARTITION BY reference ORDER BY p) AS BIGINT) AS depth FROM (SELECT reference, p, sum(d) AS d FROM (SELECT reference, reference_start AS p, 1 AS d FROM $molecules UNION ALL SELECT reference, reference_end, -1 FROM $molecules) GROUP BY 1, 2)) WHERE "end" IS NOT NULL AND depth > 0""")
def agg_coverage_bedgraph(t: Tables):
    return grid.coverage_steps(t.molecules, ("reference",), "reference_start", "reference_end")


@query("SELECT reference, b.range AS bin, CAST(sum(least(reference_end, b.range * 50 + 50) - greatest(reference_start, b.range * 50)) AS BIGINT) AS covered, count(*) AS spans FROM $molecules JOIN range(20) b ON reference_start < b.range * 50 + 50 AND reference_end > b.range * 50 GROUP BY 1, 2")
def agg_binned_coverage(t: Tables):
    return grid.binned_coverage(t.molecules, ("reference",), "reference_start", "reference_end", 50)
