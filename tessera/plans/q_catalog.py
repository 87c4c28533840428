"""Catalog, sinks read back, generations and planning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import cigar as C
from tessera.functions import sequences as S
from tessera.sources.shared import shared_dir
from tessera.plans import catalog, projects
from tessera.plans.registry import Tables, query
from tessera.sources import tables as io


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/tessera/{name}-{uuid.uuid4().hex}"


def _catalog(t: Tables) -> catalog.Catalog:
    experiments = t.customer.select(F.col("c_custkey").alias("experiment"), F.col("c_mktsegment").alias("modality"), F.when(F.col("c_acctbal") > 0, "active").otherwise("retired").alias("status"), "c_nationkey")
    refs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("experiment"), F.col("o_orderstatus").alias("canonical_reference"), F.col("c_mktsegment").alias("modality"), F.col("o_orderkey").alias("reference_uid"))
    intervals = t.lineitem.select(F.col("l_orderkey").alias("reference_uid"), F.col("l_partkey").alias("start_bin"), F.col("l_quantity").alias("n_reads"))
    return catalog.Catalog(t.spark, experiments=experiments, refs=refs, intervals=intervals)


@query("SELECT o_orderstatus AS canonical_reference, count(DISTINCT o_custkey) AS experiments, round(sum(l_quantity), 2) AS reads FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def catalog_sql(t: Tables):
    return _catalog(t).query("SELECT r.canonical_reference, count(DISTINCT r.experiment) AS experiments, round(sum(i.n_reads), 2) AS reads FROM {refs} r JOIN {intervals} i ON i.reference_uid = r.reference_uid GROUP BY 1")


@query("SELECT DISTINCT o_custkey AS experiment, o_orderstatus AS canonical_reference FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 0 AND c_nationkey < 5")
def catalog_saved_set(t: Tables):
    c = _catalog(t)
    c.add_set("chosen", predicate="status = 'active' and c_nationkey < 5")
    return c.select(canonical="F", set_name="chosen").select("experiment", "canonical_reference").distinct()


REGISTRATIONS = "SELECT o_orderkey AS seq, CAST(o_custkey AS STRING) AS experiment, CASE WHEN o_orderkey % 7 = 0 THEN 'remove' WHEN o_orderkey % 5 = 0 THEN 'activate' ELSE 'add' END AS action, CASE WHEN o_orderkey % 3 = 0 THEN 'redo' ELSE 'original' END AS lineage, o_orderpriority AS stage, 'run-' || CAST(o_orderkey AS STRING) AS path FROM {orders}"


@query(f"""WITH l AS ({REGISTRATIONS.format(orders="orders")}), s AS (SELECT experiment, arg_max(action, seq) FILTER (action <> 'activate') AS last, coalesce(arg_max(lineage, seq) FILTER (action = 'activate'), arg_min(lineage, seq) FILTER (action = 'add')) AS lineage FROM l GROUP BY 1),
p AS (SELECT experiment, lineage, stage, arg_max(path, seq) AS path FROM l WHERE action = 'add' GROUP BY ALL) SELECT p.* FROM p JOIN s ON s.experiment = p.experiment AND s.lineage = p.lineage WHERE s.last = 'add'""")
def catalog_experiments(t: Tables):
    return projects.experiments(t.spark.sql(REGISTRATIONS, orders=t.orders))


@query("WITH RECURSIVE r AS (SELECT 0 AS d, n_nationkey AS k FROM nation WHERE n_nationkey = 0 UNION ALL SELECT d + 1, (k * 7 + 3) % 25 FROM r WHERE d < 10) SELECT d, k, n_name FROM r JOIN nation ON n_nationkey = k")
def catalog_recursive_sql(t: Tables):
    c = catalog.Catalog(t.spark, nation=t.nation)
    return c.query("WITH RECURSIVE r(d, k) AS (SELECT 0, n_nationkey FROM {nation} WHERE n_nationkey = 0 UNION ALL SELECT d + 1, (k * 7 + 3) % 25 FROM r WHERE d < 10) SELECT d, k, n_name FROM r JOIN {nation} ON n_nationkey = k")


@query("SELECT s_suppkey AS uid, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_name END, a.alias, CAST(s_suppkey AS VARCHAR)) AS canonical_reference FROM supplier LEFT JOIN (SELECT c_custkey AS uid, min(c_name) AS alias FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) a ON a.uid = s_suppkey")
def catalog_canonical_names(t: Tables):
    refs = t.supplier.select(F.col("s_suppkey").alias("uid"))
    names = t.supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("name"))
    aliases = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("alias"))
    return catalog.canonical_names(refs, names, aliases).select("uid", "canonical_reference")


@query("SELECT experiment, string_agg(stage, ',' ORDER BY stage) AS stages, n FROM (SELECT DISTINCT o_custkey AS experiment, o_orderstatus AS stage, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) GROUP BY 1, 3")
def catalog_set_members(t: Tables):
    return t.orders.groupBy(F.col("o_custkey").alias("experiment")).agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("stages"), F.count("*").alias("n"))


@query("SELECT reference, n, n * 60 * 3 * 16 AS bytes, n * 60 * 3 * 16 > 2000000 AS refused FROM (SELECT reference, count(DISTINCT read_id) AS n FROM $calls GROUP BY 1)")
def catalog_estimate_selection(t: Tables):
    n = t.calls.groupBy("reference").agg(F.count_distinct("read_id").alias("n"))
    size = F.col("n") * 60 * 3 * 16
    return n.select("reference", "n", size.alias("bytes"), (size > 2000000).alias("refused"))


@query("SELECT o_custkey AS experiment, o_orderkey AS lineage FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def catalog_active_lineage(t: Tables):
    from pyspark.sql.window import Window

    order = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(order, F.desc("o_orderdate"), "o_orderkey"))
    return t.orders.withColumn("r", r).where("r = 1").select(F.col("o_custkey").alias("experiment"), F.col("o_orderkey").alias("lineage"))


@query("SELECT o_custkey AS experiment, count(*) AS lineages FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1")
def catalog_lineage_conflicts(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("experiment"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("old").alias("status"))
    return catalog.one_lineage(rows)


@query("SELECT o_orderkey AS generation, prune FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) > 20 AND o_orderkey % 10 > 0 AND o_orderdate < TIMESTAMP '1999-01-01' AS prune FROM orders)")
def catalog_prune_plan(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("generation"), F.col("o_orderpriority").alias("stage"), F.col("o_orderdate").alias("created"), (F.col("o_orderkey") % 10 == 0).alias("pinned"))
    return catalog.prune_plan(rows, 20, "1999-01-01 00:00:00").select("generation", "prune")


@query("SELECT c.c_custkey AS cache, CASE WHEN o.h IS NULL THEN 'orphan' WHEN o.h = c.c_custkey % 7 THEN 'fresh' ELSE 'stale' END AS state FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) % 7 AS h FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def catalog_cache_inventory(t: Tables):
    now = t.orders.groupBy(F.col("o_custkey").alias("cache")).agg((F.max("o_orderkey") % 7).alias("h"))
    rows = t.customer.select(F.col("c_custkey").alias("cache")).join(now, "cache", "left")
    state = F.when(F.col("h").isNull(), "orphan").when(F.col("h") == F.col("cache") % 7, "fresh").otherwise("stale")
    return rows.select("cache", state.alias("state"))


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS seconds, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS peak FROM events GROUP BY 1")
def catalog_perf_summary(t: Tables):
    return t.events.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("seconds"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("peak"))


@query("SELECT * FROM (VALUES ('raw', 'compatible'), ('preprocess', 'stale_config'), ('spatial', 'dependent_recompute'), ('hmm', 'missing'), ('latent', 'stale_algorithm')) v(node, state)")
def catalog_semantic_plan(t: Tables):
    old, new = catalog.Planner(), catalog.Planner()
    for planner, cut, version in ((old, "0.1", "1"), (new, "0.2", "2")):
        planner.register(catalog.Node("raw"))
        planner.register(catalog.Node("preprocess", ("raw",), settings=(("cut", cut),)))
        planner.register(catalog.Node("spatial", ("preprocess",)))
        planner.register(catalog.Node("hmm", ("preprocess",)))
        planner.register(catalog.Node("latent", ("spatial",), version=version))
    recorded = {n: old.record(n) for n in ("raw", "preprocess", "spatial", "latent")}
    return t.spark.createDataFrame(sorted(new.plan(["latent", "hmm"], recorded).items()), "node string, state string")


@query("SELECT reference, CAST(floor(reference_start / 100.0) AS BIGINT) AS start_bin, min(reference_start) AS min_start, max(reference_start + l) AS max_end, count(*) AS n_reads, CAST(sum(l) AS BIGINT) AS aligned_bases FROM (SELECT *, list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MD]', 1), lambda x: CAST(x AS BIGINT)))::BIGINT AS l FROM $segments) GROUP BY 1, 2")
def sink_zone_map(t: Tables):
    return io.zone_map(t.segments, 100, C.reference_length(F.col("cigar")))


@query("SELECT read_id, reference, reference_start, cigar FROM (SELECT *, list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MD]', 1), lambda x: CAST(x AS BIGINT)))::BIGINT AS l FROM $segments) WHERE reference = 'refA' AND reference_start < 260 AND reference_start + l > 200")
def sink_partitioned_store(t: Tables):
    path = _folder(t, "store")
    io.write_store(t.segments, path, C.reference_length(F.col("cigar")), 10)
    rows = io.read_store(t.spark, path, "refA", (200, 260))
    return rows.select("read_id", F.col("reference").cast("string").alias("reference"), "reference_start", "cigar")


@query("SELECT sample, count(*) AS records, CAST(sum(length(sequence)) AS BIGINT) AS bases FROM $segments GROUP BY 1")
def sink_fastq_export(t: Tables):
    path = _folder(t, "fastq")
    rows = t.segments
    scores = F.transform(F.sequence(F.lit(1), F.length("sequence")), lambda i: F.lit(30))
    record = F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), S.phred_string(scores))
    io.write_fastq(rows.select("sample", record.alias("record")), path, "sample")
    back = t.spark.read.text(path)
    bases = F.when(F.col("value").rlike("^[ACGT]+$"), F.length("value")).otherwise(0)
    return back.groupBy("sample").agg(F.count_if(F.col("value").startswith("@")).alias("records"), F.sum(bases).cast("long").alias("bases"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def sink_versioned_generation(t: Tables):
    root = _folder(t, "generations")
    io.write_versioned(t.orders.limit(10), root)
    io.write_versioned(t.orders, root, ("o_orderpriority",))
    rows = io.read_current(t.spark, root)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT read_id, max(call) FILTER (position = 3) AS p3, max(call) FILTER (position = 17) AS p17, max(call) FILTER (position = 42) AS p42 FROM $calls WHERE position IN (3, 17, 42) GROUP BY 1")
def sink_wide_view(t: Tables):
    return io.wide(t.calls, [3, 17, 42])


@query("SELECT sample, count(*) AS n, count(mapping) AS mapped FROM (SELECT o_orderpriority AS sample, NULL AS mapping FROM orders UNION ALL SELECT c_mktsegment, c_custkey FROM customer) GROUP BY 1")
def sink_outer_concat(t: Tables):
    a = t.orders.select(F.col("o_orderpriority").alias("sample"))
    b = t.customer.select(F.col("c_mktsegment").alias("sample"), F.col("c_custkey").alias("mapping"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("sample").agg(F.count("*").alias("n"), F.count("mapping").alias("mapped"))


@query("SELECT o_orderkey AS read_id, 'b' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) AS bucket FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) = '0a'")
def sink_bucketed_index(t: Tables):
    path = _folder(t, "index")
    bucket = S.bucket(F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    t.orders.select(F.col("o_orderkey").alias("read_id"), bucket.alias("bucket")).write.partitionBy("bucket").parquet(path)
    return t.spark.read.parquet(path).where("bucket = 'b0a'").select("read_id", F.col("bucket").cast("string").alias("bucket"))
