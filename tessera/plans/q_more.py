"""Variant sites, barcode clusters, rolling neighbours, peaks, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import cigar as C
from tessera.operators import grid, islands, qc, variants
from tessera.operators.order import global_rank
from tessera.plans.registry import Tables, query
from tessera.sources import tables as io
from tessera.sources.shared import shared_dir

PAIR = "(SELECT p.range AS position, substr(x.sequence, p.range + 1, 1) AS a, substr(y.sequence, p.range + 1, 1) AS b FROM $references x, $references y, range(600) p WHERE x.reference = 'refA' AND y.reference = 'refB')"
STATUS = f"(SELECT *, CASE WHEN a = b THEN 'same' WHEN (a = 'C' AND b = 'T') OR (a = 'T' AND b = 'C') THEN 'overlapping_sets' ELSE 'callable' END AS status FROM {PAIR})"


def _pair(t: Tables):
    b = grid.bases(t.references)
    x = b.where("reference = 'refA'").select("position", F.col("base").alias("a"))
    return x.join(b.where("reference = 'refB'").select("position", F.col("base").alias("b")), "position")


@query(f"SELECT * FROM {STATUS}")
def scalar_informative_sites(t: Tables):
    return variants.informative_sites(_pair(t))


OBSERVED = "(SELECT l_orderkey AS read_id, l_partkey % 600 AS position, substr('ACGTN', CAST((l_suppkey + l_linenumber) % 5 + 1 AS INT), 1) AS base FROM lineitem)"


@query(f"""SELECT o.read_id, position, base, CASE WHEN base = 'N' THEN NULL WHEN base = a OR (a = 'C' AND base = 'T') THEN 1 WHEN base = b OR (b = 'C' AND base = 'T') THEN 2 ELSE 0 END AS variant FROM {OBSERVED} o JOIN (SELECT * FROM {STATUS} WHERE status = 'callable') s USING (position)""")
def join_variant_site_calls(t: Tables):
    seen = t.lineitem.select(F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") % 600).alias("position"), F.substring(F.lit("ACGTN"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 5 + 1).cast("int"), F.lit(1)).alias("base"))
    return variants.site_calls(seen, variants.informative_sites(_pair(t))).select("read_id", "position", "base", "variant")


@query("SELECT read_id, round(least(greatest(hi, 0.05), 0.99), 9) AS efficiency, round(least(greatest(CASE WHEN n > 1 THEN lo ELSE 0 END, 0.001), 0.10), 9) AS error FROM (SELECT read_id, max(f) AS hi, min(f) AS lo, count(*) AS n FROM (SELECT l_orderkey AS read_id, l_linestatus, avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1)")
def agg_conversion_rates(t: Tables):
    marks = t.lineitem.select(F.col("l_orderkey").alias("read_id"), "l_linestatus", (F.col("l_quantity") > 25).cast("int").alias("c"))
    made = variants.conversion_rates(marks, "read_id", "l_linestatus", "c")
    return made.select("read_id", F.round("efficiency", 9).alias("efficiency"), F.round("error", 9).alias("error"))


@query("""WITH m AS (SELECT reference, position, avg(call) AS m FROM $calls WHERE call IS NOT NULL GROUP BY 1, 2), r AS (SELECT reference, position, round(avg(m) OVER (PARTITION BY reference ORDER BY position ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS rolling FROM m),
p AS (SELECT *, rolling > lag(rolling) OVER w AND rolling >= lead(rolling) OVER w AND rolling >= 1.0 * avg(rolling) OVER (PARTITION BY reference) AS peak FROM r WINDOW w AS (PARTITION BY reference ORDER BY position)) SELECT reference, position, rolling FROM p WHERE peak""")
def agg_profile_peaks(t: Tables):
    mean = t.calls.where("call is not null").groupBy("reference", "position").agg(F.avg("call").alias("m"))
    rolled = islands.rolling_mean(mean, ("reference",), "position", "m", 5).select("reference", "position", F.round("rolling", 9).alias("rolling"))
    return variants.profile_peaks(rolled, ("reference",), "position", "rolling", 1.0)


@query()
def agg_complexity_saturation(t: Tables):
    """Library size of each sample by the saturation curve at full depth; the inversion is tested."""
    rows = t.orders.select(F.col("o_orderpriority").alias("sample"), F.col("o_custkey").alias("cluster"), "o_orderkey")
    full = qc.complexity_curve(rows, ("sample",), "cluster", "o_orderkey", 6).where("depth = 5").collect()
    return t.spark.createDataFrame([(r["sample"], r["reads"], r["unique"], round(qc.saturation(r["unique"], r["reads"]), 3)) for r in full], "sample string, reads long, unique long, library_size double")


@query("""WITH w AS (SELECT reference, sample, read_id, s.range * 10 AS start, bit_or(CAST(1 AS BIGINT) << CAST(position AS INT)) AS v, bit_or(CASE WHEN call > 0 THEN CAST(1 AS BIGINT) << CAST(position AS INT) ELSE 0 END) AS b FROM $calls JOIN range(6) s ON position >= s.range * 10 AND position < s.range * 10 + 10 WHERE call IS NOT NULL GROUP BY 1, 2, 3, 4),
d AS (SELECT x.reference, x.sample, x.read_id, x.start, min(bit_count(xor(x.b, y.b) & x.v & y.v) / CAST(bit_count(x.v & y.v) AS DOUBLE)) AS distance FROM w x JOIN w y ON x.reference = y.reference AND x.sample = y.sample AND x.start = y.start AND x.read_id <> y.read_id AND bit_count(x.v & y.v) >= 4 GROUP BY 1, 2, 3, 4) SELECT reference, sample, read_id, start, round(distance, 9) AS distance FROM d""")
def win_rolling_neighbours(t: Tables):
    return variants.rolling_neighbours(t.calls, ("reference", "sample"), 60, 10, 10, 4).withColumn("distance", F.round("distance", 9))


@query()
def set_umi_directional(t: Tables):
    """Barcodes absorbed by commoner ones within one edit; tested on worked examples."""
    counts = t.umis.groupBy("sample", F.col("umi1").alias("umi")).agg(F.count("*").alias("reads"))
    return variants.directional_clusters(counts, ("sample",), "umi")


@query()
def win_top_segments(t: Tables):
    """Up to three segments a read that overlap by at most five positions; tested on a worked example."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("read_id"), F.col("l_suppkey").alias("partner"), (F.col("l_partkey") % 300).alias("start"), (F.col("l_partkey") % 300 + F.col("l_quantity").cast("long")).alias("end"))
    return variants.top_segments(rows, "read_id", "partner", 3, 5, 10)


@query("""WITH p AS (SELECT sample, position AS lag, avg(call) AS h, CAST(count(*) AS DOUBLE) AS w FROM $calls WHERE call IS NOT NULL GROUP BY 1, 2), s AS (SELECT sample, count(*) AS n, sum(w) AS w, sum(w * lag) AS x, sum(w * ln(h)) AS y, sum(w * lag * lag) AS xx, sum(w * lag * ln(h)) AS xy FROM p WHERE h > 0 GROUP BY 1)
SELECT sample, n, round((w * xy - x * y) / (w * xx - x * x), 6) AS slope, round((y - (w * xy - x * y) / (w * xx - x * x) * x) / w, 6) AS intercept FROM s""")
def stat_weighted_decay(t: Tables):
    pts = t.calls.where("call is not null").groupBy("sample", F.col("position").alias("lag")).agg(F.avg("call").alias("h"), F.count("*").cast("double").alias("w"))
    made = variants.weighted_decay(pts, ("sample",), "lag", "h", "w")
    return made.select("sample", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def topk_global_rank(t: Tables):
    return global_rank(t.orders.select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey").select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderpriority AS sample, min(r) AS start_row, max(r) + 1 AS end_row FROM (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) - 1 AS r FROM orders) GROUP BY 1")
def scan_barcode_ranges(t: Tables):
    rows = t.orders.select(F.col("o_orderpriority").alias("sample"), F.concat("o_orderpriority", F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("place"))
    return io.row_ranges(rows, "sample", "place")


@query("SELECT length(sequence) AS size, count(*) AS n, round(avg(reference_start), 6) AS mean, round(stddev_samp(reference_start), 6) AS sd FROM $segments GROUP BY 1")
def plot_size_histogram(t: Tables):
    return t.segments.groupBy(F.length("sequence").cast("long").alias("size")).agg(F.count("*").alias("n"), F.round(F.avg("reference_start"), 6).alias("mean"), F.round(F.stddev_samp("reference_start"), 6).alias("sd"))


@query("SELECT reference, CAST(floor(reference_start / 25.0) AS BIGINT) AS bin, length(sequence) AS size, count(*) AS n FROM $segments GROUP BY 1, 2, 3")
def plot_size_contours(t: Tables):
    return t.segments.groupBy("reference", F.floor(F.col("reference_start") / 25).alias("bin"), F.length("sequence").cast("long").alias("size")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS stage, count(*) AS rows, count(DISTINCT o_custkey) AS members FROM orders GROUP BY 1")
def sink_export_bundle(t: Tables):
    """A bundle of tables in one generation with a manifest, read back through the manifest."""
    root = f"{shared_dir(t.spark)}/tessera/bundle-{uuid.uuid4().hex}"
    io.write_bundle(root, {"reads": t.orders, "identity": t.orders.select("o_orderkey", "o_custkey").distinct()})
    back = io.read_bundle(t.spark, root)
    rows = back["reads"].join(back["identity"].withColumnRenamed("o_custkey", "member"), "o_orderkey")
    return rows.groupBy(F.col("o_orderstatus").alias("stage")).agg(F.count("*").alias("rows"), F.count_distinct("member").alias("members"))


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS bases FROM (SELECT reference, CAST(sum(length(sequence)) AS BIGINT) AS n FROM $segments GROUP BY 1)")
def sink_region_bases(t: Tables):
    per = t.segments.groupBy("reference").agg(F.sum(C.query_length(F.col("cigar"))).alias("n"))
    return per.agg(F.count("*").alias("files"), F.sum("n").alias("bases"))
