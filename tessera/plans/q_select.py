"""Scans, filters, sinks read back, and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import cigar as C
from tessera.operators import grid, select
from tessera.plans.registry import Tables, query


@query("SELECT read_id, sample, reference_start, reference_end FROM $molecules WHERE reference IN ('refA') AND sample IN ('1-URGENT', '5-LOW') AND reference_start < 120 AND reference_end > 100")
def scan_molecule_index(t: Tables):
    return select.scan_index(t.molecules, reference=["refA"], sample=["1-URGENT", "5-LOW"], start=100, end=120, columns=["read_id", "sample", "reference_start", "reference_end"])


@query("SELECT read_id, reference, reference_start, cigar FROM (SELECT *, reference_start + 25 AS reference_end FROM $segments) WHERE reference = 'refB' AND read_id IN (3, 5, 7, 11, 13, 101, 1009) AND reference_start < 500 AND reference_end > 10")
def scan_segment_index(t: Tables):
    rows = t.segments.withColumn("reference_end", F.col("reference_start") + 25)
    return select.scan_index(rows, reference=["refB"], read_id=[3, 5, 7, 11, 13, 101, 1009], start=10, end=500, columns=["read_id", "reference", "reference_start", "cigar"])


@query("SELECT DISTINCT l_orderkey AS molecule, l_suppkey AS task FROM lineitem WHERE l_returnflag = 'R'")
def scan_derived_index(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("molecule"), F.col("l_suppkey").alias("task"), "l_returnflag")
    return select.scan_index(rows, l_returnflag=["R"], distinct=("molecule", "task"), columns=["molecule", "task"])


@query("SELECT c.read_id, c.position, c.signal, c.call FROM $calls c JOIN (SELECT DISTINCT o_orderkey AS read_id FROM orders WHERE o_orderstatus = 'F') m USING (read_id) WHERE c.position >= 10 AND c.position < 20")
def scan_layer_window(t: Tables):
    chosen = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("read_id"))
    return t.calls.where("position >= 10 and position < 20").join(chosen, "read_id", "left_semi").select("read_id", "position", "signal", "call")


@query("""SELECT m.read_id, c.position, coalesce(c.call, -1) AS call, coalesce(c.quality, 0) AS quality FROM $molecules m LEFT JOIN (SELECT * FROM $calls WHERE position < 5) c ON c.read_id = m.read_id
WHERE m.sample = '2-HIGH' AND m.reference_start < 50""")
def scan_overlay_layers(t: Tables):
    chosen = select.scan_index(t.molecules.where("reference_start < 50"), sample=["2-HIGH"], columns=["read_id"])
    layers = t.calls.where("position < 5").select("read_id", "position", "call", "quality")
    return chosen.join(layers, "read_id", "left").select("read_id", "position", F.coalesce("call", F.lit(-1)).alias("call"), F.coalesce("quality", F.lit(0.0)).alias("quality"))


@query("SELECT reference, n, round(n / sum(n) OVER (), 9) AS share FROM (SELECT reference, count(*) AS n FROM $segments GROUP BY reference)")
def scan_count_aligned(t: Tables):
    n = t.segments.groupBy("reference").agg(F.count("*").alias("n"))
    return n.select("reference", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


@query("SELECT o_orderkey AS read_id, CAST(o_orderkey * 37 % 4096 AS BIGINT) AS flag FROM orders WHERE (o_orderkey * 37 % 4096) & 2304 <> 0")
def scan_secondary_flags(t: Tables):
    flag = F.col("o_orderkey") * 37 % 4096
    return t.orders.select(F.col("o_orderkey").alias("read_id"), flag.cast("long").alias("flag")).where(F.col("flag").bitwiseAND(0x100 | 0x800) != 0)


@query("""SELECT l_orderkey AS read_id, l_partkey % 100 AS query_position,
 max(CASE WHEN l_returnflag = 'R' THEN l_discount * 10 WHEN l_returnflag = 'A' THEN 1 - l_discount * 10 ELSE 0 END) AS probability FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY 1, 2""")
def scan_direct_calls(t: Tables):
    code = F.when(F.col("l_returnflag") == "R", F.col("l_discount") * 10).when(F.col("l_returnflag") == "A", 1 - F.col("l_discount") * 10).otherwise(0.0)
    reads = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("read_id"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") % 100).alias("query_position"), code.alias("probability"))
    return rows.join(reads, "read_id").groupBy("read_id", "query_position").agg(F.max("probability").alias("probability"))


@query("SELECT p_partkey AS region, 'chr' || CAST(p_size % 3 AS VARCHAR) AS reference, least(p_partkey * 7 % 1000, 990) AS start, least(p_partkey * 7 % 1000 + p_size, 1000) AS stop FROM part WHERE least(p_partkey * 7 % 1000, 990) < least(p_partkey * 7 % 1000 + p_size, 1000)")
def scan_bed_regions(t: Tables):
    start, stop = F.col("p_partkey") * 7 % 1000, F.col("p_partkey") * 7 % 1000 + F.col("p_size")
    rows = t.part.select(F.col("p_partkey").alias("region"), F.concat(F.lit("chr"), (F.col("p_size") % 3).cast("string")).alias("reference"), F.least(start, F.lit(990)).cast("long").alias("start"), F.least(stop, F.lit(1000)).cast("long").alias("stop"))
    return rows.where("start < stop")


@query("SELECT o.o_orderkey AS read_id, c.c_name AS sample_name, c.c_mktsegment AS treatment FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def scan_sample_sheet(t: Tables):
    sheet = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("sample_name"), F.col("c_mktsegment").alias("treatment"))
    return t.orders.join(sheet, "o_custkey", "left").select(F.col("o_orderkey").alias("read_id"), "sample_name", "treatment")


@query("SELECT doc_id, sha256(text) AS content_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def scan_input_manifest(t: Tables):
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_id"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT status, double_ended, count(*) AS n FROM (SELECT CASE WHEN a >= 60 AND b >= 60 THEN 'double' WHEN a >= 60 OR b >= 60 THEN 'single' ELSE 'unclassified' END AS status, a >= 60 AND b >= 60 AS double_ended FROM (SELECT o_orderkey % 101 AS a, o_custkey % 103 AS b FROM orders)) GROUP BY ALL")
def scan_demux_status(t: Tables):
    rows = t.orders.select((F.col("o_orderkey") % 101).alias("a"), (F.col("o_custkey") % 103).alias("b"))
    status = F.when((F.col("a") >= 60) & (F.col("b") >= 60), "double").when((F.col("a") >= 60) | (F.col("b") >= 60), "single").otherwise("unclassified")
    return rows.select(status.alias("status"), ((F.col("a") >= 60) & (F.col("b") >= 60)).alias("double_ended")).groupBy("status", "double_ended").agg(F.count("*").alias("n"))


@query("""SELECT read_id, read_length BETWEEN 500 AND 4000 AND coalesce(read_quality >= 10, false) AND mapping_quality >= 5
 AND mapped_length / CAST(read_length AS DOUBLE) BETWEEN 0.8 AND 1.0 AND read_length / CAST(reference_length AS DOUBLE) <= 3 AS passes_read_qc FROM $molecules""")
def filter_read_qc_mask(t: Tables):
    m = t.molecules
    return m.select("read_id", select.read_quality(m, read_length=(4000, 500), read_quality=(10, None), mapping_quality=(5, None), mapped_to_read_ratio=(0.8, 1.0), length_ratio=(None, 3), absent_metric=(0, 1)).alias("passes_read_qc"))


@query("SELECT read_id, reference, read_length FROM $molecules WHERE read_length BETWEEN 1000 AND 3000 AND read_quality >= 15")
def filter_read_length_quality(t: Tables):
    m = t.molecules
    return m.where(select.read_quality(m, read_length=(1000, 3000), read_quality=(15, None))).select("read_id", "reference", "read_length")


@query("SELECT read_id, cigar FROM (SELECT read_id, cigar, list_max(list_transform(regexp_extract_all(cigar, '(\\d+)I', 1), lambda x: CAST(x AS INT))) AS ins, list_max(list_transform(regexp_extract_all(cigar, '(\\d+)D', 1), lambda x: CAST(x AS INT))) AS del FROM $segments) WHERE coalesce(ins, 0) <= 2 AND coalesce(del, 0) <= 3")
def filter_cigar_indels(t: Tables):
    return t.segments.where((C.longest(F.col("cigar"), "I") <= 2) & (C.longest(F.col("cigar"), "D") <= 3)).select("read_id", "cigar")


@query("""SELECT read_id, modified, valid, round(modified / CAST(valid AS DOUBLE), 9) AS fraction FROM (SELECT read_id, CAST(sum(call) AS BIGINT) AS modified, count(call) AS valid FROM $calls GROUP BY read_id)
WHERE valid > 0 AND modified / CAST(valid AS DOUBLE) BETWEEN 0.3 AND 0.8 AND valid / 60.0 >= 0.2""")
def filter_modification_thresholds(t: Tables):
    per_read = t.calls.groupBy("read_id").agg(F.sum("call").alias("modified"), F.count("call").alias("valid"))
    fraction = F.try_divide(F.col("modified").cast("double"), F.col("valid"))
    return per_read.where(select.in_range(fraction, (0.3, 0.8)) & select.in_range(F.col("valid") / 60.0, (0.2, None))).select("read_id", "modified", "valid", F.round(fraction, 9).alias("fraction"))


@query("SELECT read_id, position, call FROM $calls c WHERE read_id IN (SELECT read_id FROM $calls GROUP BY read_id HAVING 1 - count(call) / 60.0 <= 0.6)")
def filter_nan_proportion_reads(t: Tables):
    return select.drop_sparse(t.calls, "read_id", 60, 0.6).select("read_id", "position", "call")


@query("SELECT read_id, position, call FROM $calls c WHERE position IN (SELECT position FROM $calls GROUP BY position HAVING 1 - count(call) / CAST((SELECT count(DISTINCT read_id) FROM $calls) AS DOUBLE) <= 0.62)")
def filter_nan_proportion_positions(t: Tables):
    total = t.calls.select("read_id").distinct().count()
    return select.drop_sparse(t.calls, "position", total, 0.62).select("read_id", "position", "call")


@query("SELECT read_id, ct >= 3 AND ga >= 3 AND purity >= 0.9 AND CASE WHEN ct + ga = 0 THEN 1.0 ELSE greatest(ct, ga) / CAST(ct + ga AS DOUBLE) END <= 0.8 AS chimera FROM (SELECT o_orderkey AS read_id, o_orderkey % 7 AS ct, o_custkey % 9 AS ga, (o_custkey % 50) / 50.0 + 0.1 AS purity FROM orders)")
def filter_deaminase_chimera(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("read_id"), (F.col("o_orderkey") % 7).alias("ct"), (F.col("o_custkey") % 9).alias("ga"), ((F.col("o_custkey") % 50) / 50.0 + 0.1).alias("purity"))
    return rows.select("read_id", grid.chimera_mask(F.col("ct"), F.col("ga"), F.col("purity")).alias("chimera"))


@query("SELECT read_id, coalesce(a, false) OR coalesce(b, false) AS is_chimera FROM (SELECT o_orderkey AS read_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 10 = 1 END AS a, o_custkey % 10 = 2 AS b FROM orders)")
def filter_composite_chimera(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("read_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 10 == 1).alias("chimera_by_events"), (F.col("o_custkey") % 10 == 2).alias("chimera_by_variants"))
    return rows.select("read_id", grid.any_of(rows, r"^chimera_by_").alias("is_chimera"))


@query("SELECT read_id, mapping_quality FROM $molecules WHERE (sample = '1-URGENT' AND mapping_quality >= 30) OR (NOT (read_quality < 20) AND status IN ('F', 'P'))")
def filter_predicate_tree(t: Tables):
    tree = {"any": [{"all": [{"column": "sample", "op": "eq", "value": "1-URGENT"}, {"column": "mapping_quality", "op": "ge", "value": 30.0}]}, {"all": [{"not": {"column": "read_quality", "op": "lt", "value": 20.0, "missing": "true"}}, {"column": "status", "op": "in", "value": ["F", "P"]}, {"column": "absent", "op": "eq", "value": 1, "missing": "true"}]}]}
    m = t.molecules
    return m.where(select.predicate(tree, m.columns)).select("read_id", "mapping_quality")


@query("SELECT read_id, read_length FROM $molecules WHERE read_length >= 800 AND mapping_quality <= 40 AND sample IN ('2-HIGH', '5-LOW') AND status NOT IN ('P') AND reference = 'refA'")
def filter_suffix_operators(t: Tables):
    return select.suffix_filters(t.molecules, {"read_length__min": 800, "mapping_quality__max": 40, "sample__in": ["2-HIGH", "5-LOW"], "status__not_in": ["P"], "reference__eq": "refA"}).select("read_id", "read_length")


@query("SELECT read_id, reference FROM $molecules WHERE sample = '1-URGENT' AND status = 'O' AND (reference <> 'refA' OR read_id % 4 <= 2)")
def filter_obs_mask(t: Tables):
    m = t.molecules
    ok = select.predicate({"all": [{"column": "sample", "op": "eq", "value": "1-URGENT"}, {"column": "status", "op": "eq", "value": "O"}]}, m.columns)
    return m.where(ok & ((F.col("reference") != "refA") | (F.col("read_id") % 4 <= 2))).select("read_id", "reference")


@query("SELECT DISTINCT reference, position, 2 * position - 31 AS reindexed FROM $calls WHERE 2 * position - 31 BETWEEN -10 AND 40")
def filter_position_span(t: Tables):
    rows = t.calls.select("reference", "position", (2 * F.col("position") - 31).alias("reindexed")).distinct()
    return rows.where(select.in_range(F.col("reindexed"), (-10, 40)))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def filter_project_select(t: Tables):
    return t.nation.join(F.broadcast(t.region.where(F.col("r_name").isin("ASIA", "EUROPE"))), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT 'raw' AS stage, o_orderkey AS read_id, o_orderstatus AS info FROM orders WHERE o_orderkey = 1234 UNION ALL SELECT 'derived', l_orderkey, l_returnflag FROM lineitem WHERE l_orderkey = 1234")
def filter_lookup_molecule(t: Tables):
    raw = t.orders.where("o_orderkey = 1234").select(F.lit("raw").alias("stage"), F.col("o_orderkey").alias("read_id"), F.col("o_orderstatus").alias("info"))
    return raw.unionByName(t.lineitem.where("l_orderkey = 1234").select(F.lit("derived").alias("stage"), F.col("l_orderkey").alias("read_id"), F.col("l_returnflag").alias("info")))


@query("SELECT o_orderkey, o_orderdate, n, value FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1) ON k = o_orderkey")
def join_stage_obs(t: Tables):
    a = t.orders.select(F.col("o_orderkey"), "o_orderdate")
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return grid.join_stages([a, b, c], "o_orderkey")


@query("SELECT o_orderkey AS read_id, coalesce(n, 0) AS n_segments, coalesce(r, 0) AS n_returned FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def join_annotations(t: Tables):
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("read_id")).agg(F.count("*").alias("n_segments"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("n_returned"))
    rows = t.orders.select(F.col("o_orderkey").alias("read_id"))
    return rows.join(per, "read_id", "left").fillna(0, ["n_segments", "n_returned"])


@query("SELECT m.read_id, c.core FROM $molecules m, (SELECT range AS core, range * 100 AS s, least(range * 100 + 100, 560) AS e FROM range(6)) c WHERE m.reference_start < c.e AND m.reference_end > c.s")
def join_reads_to_cores(t: Tables):
    cores = t.spark.range(6).select(F.col("id").alias("core"), (F.col("id") * 100).alias("core_start"), F.least(F.col("id") * 100 + 100, F.lit(560)).alias("core_end"))
    return select.interval_join(t.molecules, cores, ("reference_start", "reference_end"), ("core_start", "core_end"), bin_width=100).select("read_id", "core")


@query("SELECT a.o_orderkey AS read_id, p.p_partkey AS region FROM (SELECT o_orderkey, o_orderkey * 7 % 100000 AS s, o_orderkey * 7 % 100000 + 20 + o_custkey % 80 AS e, CASE WHEN o_custkey % 2 = 0 THEN 'refA' ELSE 'refB' END AS reference FROM orders) a JOIN (SELECT p_partkey, p_partkey * 13 % 100000 AS s, p_partkey * 13 % 100000 + p_size AS e, CASE WHEN p_partkey % 2 = 0 THEN 'refA' ELSE 'refB' END AS reference FROM part) p ON p.reference = a.reference AND a.s < p.e AND a.e > p.s")
def join_interval_regions(t: Tables):
    side = lambda c: F.when(F.col(c) % 2 == 0, "refA").otherwise("refB").alias("reference")
    regions = t.part.select(F.col("p_partkey").alias("region"), (F.col("p_partkey") * 13 % 100000).alias("s"), (F.col("p_partkey") * 13 % 100000 + F.col("p_size")).alias("e"), side("p_partkey"))
    start = F.col("o_orderkey") * 7 % 100000
    reads = t.orders.select(F.col("o_orderkey").alias("read_id"), start.alias("start"), (start + 20 + F.col("o_custkey") % 80).alias("end"), side("o_custkey"))
    return select.interval_join(reads, regions, ("start", "end"), ("s", "e"), on=("reference",)).select("read_id", "region")


@query("""SELECT core, s, e, gap FROM (SELECT range AS core, range * 60 AS s, range * 60 + 60 AS e, NOT EXISTS (SELECT 1 FROM part WHERE p_partkey * 7919 % 60000 < range * 60 + 60 AND p_partkey * 7919 % 60000 + p_size > range * 60) AS gap FROM range(1000))""")
def join_region_gaps(t: Tables):
    cores = t.spark.range(1000).select(F.col("id").alias("core"), (F.col("id") * 60).alias("s"), (F.col("id") * 60 + 60).alias("e"))
    regions = t.part.select((F.col("p_partkey") * 7919 % 60000).alias("rs"), (F.col("p_partkey") * 7919 % 60000 + F.col("p_size")).alias("re"))
    met = select.interval_join(cores, regions, ("s", "e"), ("rs", "re"), bin_width=60).select("core").distinct().withColumn("met", F.lit(True))
    return cores.join(met, "core", "left").select("core", "s", "e", F.col("met").isNull().alias("gap"))


@query("SELECT reference, i.range AS tile, i.range * 128 AS core_start, least(i.range * 128 + 128, n) AS core_end, greatest(i.range * 128 - 16, 0) AS load_start, least(i.range * 128 + 144, n) AS load_end FROM (SELECT reference, length(sequence) AS n FROM $references) r, range(10) i WHERE i.range * 128 < n")
def join_reference_tiles(t: Tables):
    return grid.tiles(t.references.select("reference", F.length("sequence").alias("n")), "n", 128, 16)


@query("SELECT s.read_id, s.reference, CASE WHEN s.reference = 'refA' THEN s.reference_start + 10000 ELSE 50000 - s.reference_start END AS original FROM $segments s")
def join_interval_map(t: Tables):
    mapping = t.spark.createDataFrame([("refA", 1, 10000), ("refB", -1, 50000)], "reference string, sign long, shift long")
    return t.segments.join(mapping, "reference").select("read_id", "reference", (F.col("sign") * F.col("reference_start") + F.col("shift")).alias("original"))


@query("""WITH c AS (SELECT read_id, position, call FROM $calls UNION ALL SELECT read_id, position, call FROM $calls WHERE position % 7 = 0), p AS (SELECT p_partkey * 11 % 60 AS s, min(p_partkey * 11 % 60 + p_size % 7) AS e, min(p_type) AS v FROM part GROUP BY 1),
h AS (SELECT q.position, max_by(p.v, p.s) AS v FROM (SELECT DISTINCT position FROM c) q JOIN p ON p.s <= q.position AND q.position < p.e GROUP BY 1) SELECT c.read_id, c.position, c.call, coalesce(h.v, 'default') AS strand FROM c LEFT JOIN h ON h.position = c.position""")
def join_point_in_span(t: Tables):
    spans = t.part.select((F.col("p_partkey") * 11 % 60).alias("s"), (F.col("p_partkey") * 11 % 60 + F.col("p_size") % 7).alias("e"), F.col("p_type").alias("strand")).groupBy("s").agg(F.min("e").alias("e"), F.min("strand").alias("strand"))
    calls = t.calls.select("read_id", "position", "call")
    points = calls.unionByName(calls.where("position % 7 = 0"))
    return select.point_in_span(points, spans, "position", ("s", "e"), "strand", "default")


@query("SELECT c.read_id, c.position, c.call FROM $calls c ANTI JOIN (SELECT p_partkey % 60 AS position FROM part GROUP BY 1 HAVING avg(p_size) > 26) x ON x.position = c.position WHERE c.call IS NOT NULL")
def join_exclude_positions(t: Tables):
    excluded = t.part.groupBy((F.col("p_partkey") % 60).alias("position")).agg(F.avg("p_size").alias("m")).where("m > 26").select("position")
    return t.calls.where("call is not null").join(excluded, "position", "left_anti").select("read_id", "position", "call")


@query("SELECT coalesce(a.k, b.k) AS molecule, CASE WHEN a.k IS NULL THEN 'descendant_only' WHEN b.k IS NULL THEN 'parent_only' WHEN b.n > 1 THEN 'split' ELSE 'matched' END AS status, coalesce(b.n, 0) AS children FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 3) a FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.k = b.k")
def join_qc_transition(t: Tables):
    parent = t.orders.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("molecule"), F.lit(True).alias("p"))
    child = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("molecule")).agg(F.count("*").alias("n"))
    both = parent.join(child, "molecule", "full")
    status = F.when(F.col("p").isNull(), "descendant_only").when(F.col("n").isNull(), "parent_only").when(F.col("n") > 1, "split").otherwise("matched")
    return both.select("molecule", status.alias("status"), F.coalesce("n", F.lit(0)).alias("children"))


@query("SELECT s_suppkey AS read_id, coalesce(c.c_mktsegment, n.n_name, 'unknown') AS identity, c.c_mktsegment IS NOT NULL AND n.n_name IS NOT NULL AND s_suppkey % 7 = 0 AS conflict FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON c.c_custkey = s_suppkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n.n_nationkey = s_nationkey")
def join_identity_precedence(t: Tables):
    first = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("s_suppkey"), "c_mktsegment")
    second = F.broadcast(t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"))
    rows = t.supplier.join(first, "s_suppkey", "left").join(second, "s_nationkey", "left")
    conflict = F.col("c_mktsegment").isNotNull() & F.col("n_name").isNotNull() & (F.col("s_suppkey") % 7 == 0)
    return rows.select(F.col("s_suppkey").alias("read_id"), F.coalesce("c_mktsegment", "n_name", F.lit("unknown")).alias("identity"), conflict.alias("conflict"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE coalesce(s, 'none') END AS status FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS s FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON l_orderkey = o_orderkey")
def join_fill_only(t: Tables):
    lookup = t.lineitem.where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("found"))
    rows = t.orders.withColumn("status", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")))
    return rows.join(lookup, "o_orderkey", "left").select("o_orderkey", F.coalesce("status", "found", F.lit("none")).alias("status"))


@query("SELECT o_orderkey AS read_id, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) AS has_secondary FROM orders")
def join_membership_flags(t: Tables):
    return grid.member_flag(t.orders.select(F.col("o_orderkey").alias("read_id")), t.lineitem.where("l_quantity >= 45").select(F.col("l_orderkey").alias("read_id")), "read_id", "has_secondary")


@query("SELECT o_orderkey, 'double' AS kind FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT l_orderkey, 'single' FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_prefer_double(t: Tables):
    double = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("double").alias("kind"))
    single = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(double, "o_orderkey", "left_anti").withColumn("kind", F.lit("single"))
    return double.unionByName(single)
