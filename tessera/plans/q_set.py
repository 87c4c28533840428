"""Set operations, deduplication, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import cigar as C
from tessera.functions import sequences as S
from tessera.operators import dedup, grid
from tessera.plans.registry import Tables, query


@query("SELECT 'lineitem' AS experiment, l_orderkey AS read_id, CAST(l_partkey AS BIGINT) AS start, NULL AS sample FROM lineitem UNION ALL SELECT 'orders', o_orderkey, NULL, o_orderpriority FROM orders")
def set_union_catalogs(t: Tables):
    a = t.lineitem.select(F.lit("lineitem").alias("experiment"), F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("start"))
    b = t.orders.select(F.lit("orders").alias("experiment"), F.col("o_orderkey").alias("read_id"), F.col("o_orderpriority").alias("sample"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_orderkey AS read_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1 HAVING count(*) > 1")
def set_pooled_duplicates(t: Tables):
    both = t.orders.select(F.col("o_orderkey").alias("read_id")).union(t.lineitem.where("l_linenumber = 1").select("l_orderkey"))
    return both.groupBy("read_id").agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT k AS experiment, 'resolved' AS state FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL
SELECT k, 'missing' FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT k, 'inactive' FROM ((SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def set_membership(t: Tables):
    declared = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("experiment"))
    registered, active = t.orders.select(F.col("o_custkey").alias("experiment")), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("experiment"))
    parts = {"resolved": declared.intersect(active), "missing": declared.subtract(registered), "inactive": declared.intersect(registered).subtract(active)}
    out = None
    for state, rows in parts.items():
        rows = rows.withColumn("state", F.lit(state))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'content_mutated' ELSE 'identical' END AS change FROM (SELECT o_orderkey AS k, o_totalprice AS h FROM orders WHERE o_orderkey % 10 < 9) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_totalprice END AS h FROM orders WHERE o_orderkey % 10 > 0) b ON a.k = b.k) GROUP BY 1")
def set_manifest_transition(t: Tables):
    a = t.orders.where("o_orderkey % 10 < 9").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("h"))
    b = t.orders.where("o_orderkey % 10 > 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 50 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("g"))
    kind = F.when(F.col("h").isNull(), "added").when(F.col("g").isNull(), "removed").when(F.col("h") != F.col("g"), "content_mutated").otherwise("identical")
    return a.join(b, "k", "full").groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


PACK = "(SELECT read_id, reference, sample, CAST(sum(CASE WHEN call = 1 THEN CAST(1 AS BIGINT) << CAST(position AS INT) ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN call IS NOT NULL THEN CAST(1 AS BIGINT) << CAST(position AS INT) ELSE 0 END) AS BIGINT) AS v FROM $calls GROUP BY 1, 2, 3)"


@query(f"SELECT x.read_id AS a, y.read_id AS b, CAST(bit_count(xor(x.b, y.b) & x.v & y.v) AS INT) AS mismatches, CAST(bit_count(x.v & y.v) AS INT) AS overlap FROM {PACK} x JOIN {PACK} y ON x.reference = y.reference AND x.sample = y.sample AND x.read_id < y.read_id JOIN (SELECT reference, sample, min(read_id) AS first FROM {PACK} GROUP BY 1, 2) f ON f.reference = x.reference AND f.sample = x.sample AND f.first = x.read_id WHERE bit_count(x.v & y.v) >= 3")
def set_masked_hamming(t: Tables):
    """Every read against its group's first one, as a check of the distance; clusters are set_near_duplicate_reads."""
    rows = dedup.packed(t.calls, ("reference", "sample", "read_id"), "position", "call", 60)
    differ, shared = dedup.masked_hamming("x", "y")
    first = rows.groupBy("reference", "sample").agg(F.min(F.struct("read_id", "bits", "valid")).alias("f")).select("reference", "sample", "f.*")
    pairs = rows.alias("y").join(first.alias("x"), (F.col("x.reference") == F.col("y.reference")) & (F.col("x.sample") == F.col("y.sample")) & (F.col("x.read_id") < F.col("y.read_id")))
    return pairs.select(F.col("x.read_id").alias("a"), F.col("y.read_id").alias("b"), differ.alias("mismatches"), shared.alias("overlap")).where("overlap >= 3")


@query()
def set_near_duplicate_reads(t: Tables):
    """A row for each read: its cluster of reads that differ in under a fifth of 12 shared calls or more; recall is measured against brute force in the tests."""
    return dedup.duplicate_reads(t.calls, ("reference", "sample"), 60, least_overlap=12, threshold=0.2)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey = s_suppkey * 7 AND c_nationkey % 3 = s_nationkey % 3), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT n_nationkey AS node, n_nationkey AS c FROM nation UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.c)
SELECT node, min(c) AS component FROM r GROUP BY 1""")
def set_connected_components(t: Tables):
    e = t.customer.join(t.supplier.withColumn("c_custkey", F.col("s_suppkey") * 7), "c_custkey").where("c_nationkey % 3 = s_nationkey % 3").select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"))
    return dedup.connected(t.nation.select(F.col("n_nationkey").alias("node")), e)


@query("SELECT o_orderkey AS read_id, row_number() OVER w > 1 AS is_duplicate, count(*) OVER (PARTITION BY o_custkey) AS cluster_size FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey)")
def set_duplicate_keepers(t: Tables):
    made = dedup.keepers(t.orders, "o_custkey", [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), F.col("o_orderkey")])
    return made.select(F.col("o_orderkey").alias("read_id"), "is_duplicate", "cluster_size")


@query("SELECT x.sample, x.u AS a, y.u AS b FROM (SELECT DISTINCT sample, umi1 AS u FROM $umis) x JOIN (SELECT DISTINCT sample, umi1 AS u FROM $umis) y ON x.sample = y.sample AND x.u < y.u AND hamming(x.u, y.u) = 1")
def set_umi_neighbours(t: Tables):
    return dedup.one_edit_apart(t.umis, ("sample",), "umi1")


@query("""WITH RECURSIVE p AS (SELECT sample, umi1, count(*) AS reads FROM $umis GROUP BY 1, 2), r AS (SELECT sample, umi1 AS a, umi1 AS b FROM p UNION SELECT r.sample, r.a, q.umi1 FROM r JOIN p q ON q.sample = r.sample AND hamming(q.umi1, r.b) = 1),
c AS (SELECT sample, a AS umi1, min(b) AS component FROM r GROUP BY 1, 2), f AS (SELECT * FROM p JOIN c USING (sample, umi1))
SELECT sample, umi1, reads, first_value(umi1) OVER (PARTITION BY sample, component ORDER BY reads DESC, translate(umi1, 'ACGTN', 'TGCA0') DESC) AS representative, count(*) OVER (PARTITION BY sample, component) AS barcodes, CAST(sum(reads) OVER (PARTITION BY sample, component) AS BIGINT) AS cluster_reads FROM f""")
def set_umi_clusters(t: Tables):
    return dedup.umi_clusters(t.umis, ("sample",), "umi1")


@query("SELECT x.n_regionkey AS block, x.n_nationkey AS a, y.n_nationkey AS b, CAST(hamming(x.u, y.u) AS INT) AS distance FROM (SELECT n_regionkey, n_nationkey, substr(md5(n_name), 1, 12) AS u FROM nation) x JOIN (SELECT n_regionkey, n_nationkey, substr(md5(n_name), 1, 12) AS u FROM nation) y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
def set_pairwise_hamming(t: Tables):
    rows = t.nation.select(F.col("n_regionkey").alias("block"), F.col("n_nationkey").alias("k"), F.substring(F.md5(F.col("n_name").cast("binary")), 1, 12).alias("u"))
    return dedup.pairwise_differences(rows, "block", "k", "u")


@query("SELECT n, min(distance) AS nearest FROM (SELECT x.n_nationkey AS n, hamming(md5(x.n_name), md5(y.n_name)) AS distance FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey) GROUP BY 1")
def set_min_non_diagonal(t: Tables):
    rows = t.nation.select(F.col("n_regionkey").alias("block"), F.col("n_nationkey").alias("k"), F.md5(F.col("n_name").cast("binary")).alias("u"))
    d = dedup.pairwise_differences(rows, "block", "k", "u")
    return d.select(F.col("a").alias("n"), "distance").union(d.select("b", "distance")).groupBy("n").agg(F.min("distance").cast("long").alias("nearest"))


@query("SELECT min(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def set_exact_duplicates(t: Tables):
    return t.documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").drop("h")


@query("""SELECT read_id, list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MIS=X]', 1), lambda x: CAST(x AS BIGINT)))::BIGINT AS query_length, list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT)))::BIGINT AS reference_length,
list_max(list_transform(regexp_extract_all(cigar, '(\\d+)D', 1), lambda x: CAST(x AS BIGINT))) AS max_deletion FROM $segments""")
def scalar_cigar_lengths(t: Tables):
    c = F.col("cigar")
    return t.segments.select("read_id", C.query_length(c).alias("query_length"), C.reference_length(c).alias("reference_length"), C.longest(c, "D").alias("max_deletion"))


#: Blocks of aligned bases of the role `segments`, whose programs all read aM bI cM dD 6M.
BLOCKS = """(SELECT read_id, reference, sequence, q0 + i.range AS query_position, r0 + i.range AS position FROM (SELECT read_id, reference, sequence, unnest([0, a + b, a + b + c]) AS q0, unnest([s, s + a, s + a + c + d]) AS r0, unnest([a, c, 6]) AS n FROM
(SELECT *, CAST(5 + read_id % 6 AS BIGINT) AS a, CAST(1 + read_id % 3 AS BIGINT) AS b, CAST(regexp_extract(cigar, 'I(\\d+)M', 1) AS BIGINT) AS c, CAST(regexp_extract(cigar, '(\\d+)D', 1) AS BIGINT) AS d, reference_start AS s FROM $segments)) JOIN range(12) i ON i.range < n)"""


@query(f"SELECT read_id, count(*) AS pairs, min(query_position) AS first_query, max(position) AS last_position, CAST(sum(position * (query_position + 1)) AS BIGINT) AS moment FROM {BLOCKS} GROUP BY 1")
def scalar_aligned_pairs(t: Tables):
    pairs = C.aligned_pairs(t.segments)
    return pairs.groupBy("read_id").agg(F.count("*").alias("pairs"), F.min("query_position").alias("first_query"), F.max("position").alias("last_position"), F.sum(F.col("position") * (F.col("query_position") + 1)).alias("moment"))


@query(f"SELECT read_id, position, substr(sequence, query_position + 1, 1) AS base FROM {BLOCKS} WHERE position >= 100 AND position < 140")
def scalar_scatter_window(t: Tables):
    return C.scatter(t.segments, window=(100, 140)).select("read_id", "position", "base")


@query(f"""SELECT reference, position, covered, round(matched / CAST(covered AS DOUBLE), 9) AS identity FROM (SELECT b.reference, position, count(*) AS covered, count(*) FILTER (substr(b.sequence, query_position + 1, 1) = substr(r.sequence, position + 1, 1)) AS matched FROM {BLOCKS} b JOIN $references r ON r.reference = b.reference WHERE position < 600 GROUP BY 1, 2)""")
def scalar_reference_identity(t: Tables):
    # Bases are counted before they meet the reference: the optimizer takes expanded segments for as small as their file, and would broadcast them.
    seen = C.scatter(t.segments).groupBy("reference", "position", "base").agg(F.count("*").alias("n"))
    bases = grid.bases(t.references).select("reference", "position", F.col("base").alias("expected"))
    rows = seen.hint("merge").join(bases, ["reference", "position"])
    per = rows.groupBy("reference", "position").agg(F.sum("n").alias("covered"), F.sum(F.when(F.col("base") == F.col("expected"), F.col("n")).otherwise(0)).alias("matched"))
    return per.select("reference", "position", "covered", F.round(F.col("matched") / F.col("covered"), 9).alias("identity"))


@query("SELECT count(*) AS bad FROM (SELECT read_id FROM $segments GROUP BY 1 HAVING count(*) > 1)")
def scalar_validate_segments(t: Tables):
    return C.inconsistent(t.segments).agg(F.count("*").alias("bad"))


@query("SELECT read_id, translate(sequence, 'ACGT', '0123') AS codes, reverse(translate(sequence, 'ACGT', 'TGCA')) AS reverse_complement, replace(replace(replace(replace(sequence, 'A', '10000'), 'C', '01000'), 'G', '00100'), 'T', '00010') AS one_hot FROM $segments")
def scalar_sequence_encodings(t: Tables):
    s = F.col("sequence")
    return t.segments.select("read_id", F.array_join(S.encode(s).cast("array<string>"), "").alias("codes"), S.reverse_complement(s).alias("reverse_complement"), F.array_join(S.one_hot(s).cast("array<string>"), "").alias("one_hot"))


@query("SELECT read_id, sequence AS decoded, sequence AS from_flags FROM $segments")
def scalar_sequence_round_trip(t: Tables):
    s = F.col("sequence")
    return t.segments.select("read_id", S.decode(S.encode(s)).alias("decoded"), S.one_hot_decode(S.one_hot(s)).alias("from_flags"))


@query("SELECT o_orderkey AS read_id, '@' || CAST(o_orderkey AS VARCHAR) || chr(10) || sequence || chr(10) || '+' || chr(10) || string_agg(chr(CAST(33 + (o_orderkey + i) % 40 AS INT)), '' ORDER BY i) AS record FROM (SELECT read_id AS o_orderkey, sequence, unnest(range(length(sequence))) AS i FROM $segments) GROUP BY 1, sequence")
def scalar_fastq_records(t: Tables):
    rows = t.segments
    scores = F.transform(F.sequence(F.lit(0).cast("long"), F.length("sequence").cast("long") - 1), lambda i: ((F.col("read_id") + i) % 40).cast("int"))
    return rows.select("read_id", F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), S.phred_string(scores)).alias("record"))


@query("SELECT o_orderkey AS read_id, substr(sha256('5:orexp' || CAST(length(CAST(o_orderkey AS VARCHAR)) AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR)), 1, 32) AS uid, 'b' || substr(sha256('5:orexp' || CAST(length(CAST(o_orderkey AS VARCHAR)) AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR)), 1, 2) AS bucket FROM orders")
def scalar_molecule_uid(t: Tables):
    uid = S.molecule_uid(F.lit("orexp"), F.col("o_orderkey").cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("read_id"), uid.alias("uid"), S.bucket(uid).alias("bucket"))


@query("SELECT c_custkey AS k, c_name || '/é' AS experiment, c_mktsegment AS read, 'm1.' || rtrim(replace(replace(to_base64(encode(c_name || '/é')), '+', '-'), '/', '_'), '=') || '.' || rtrim(replace(replace(to_base64(encode(c_mktsegment)), '+', '-'), '/', '_'), '=') AS name FROM customer")
def scalar_pooled_names(t: Tables):
    name = S.pooled_name(F.concat("c_name", F.lit("/é")), F.col("c_mktsegment"))
    rows = t.customer.select(F.col("c_custkey").alias("k"), name.alias("name"))
    return rows.select("k", S.split_pooled_name(F.col("name"))["experiment"].alias("experiment"), S.split_pooled_name(F.col("name"))["read"].alias("read"), "name")


@query("SELECT reference, sha256(upper(sequence) || '|' || CAST(length(sequence) AS VARCHAR)) AS uid FROM $references")
def scalar_reference_uid(t: Tables):
    return t.references.select("reference", S.reference_uid(F.col("sequence")).alias("uid"))


CONTEXT = """(SELECT reference, i.range AS position, substr(sequence, i.range + 1, 1) AS base, CASE WHEN i.range = 0 OR i.range = length(sequence) - 1 THEN NULL WHEN substr(sequence, i.range + 1, 1) = 'C' AND substr(sequence, i.range, 1) = 'G' AND substr(sequence, i.range + 2, 1) = 'G' THEN 'ambiguous_GpC_CpG'
WHEN substr(sequence, i.range + 1, 1) = 'C' AND substr(sequence, i.range, 1) = 'G' THEN 'GpC' WHEN substr(sequence, i.range + 1, 1) = 'C' AND substr(sequence, i.range + 2, 1) = 'G' THEN 'CpG' WHEN substr(sequence, i.range + 1, 1) = 'C' THEN 'other_C' WHEN substr(sequence, i.range + 1, 1) = 'A' THEN 'A' END AS site_type FROM $references, range(600) i)"""


@query(f"SELECT * FROM {CONTEXT}")
def scalar_base_context(t: Tables):
    return grid.base_context(t.references)


@query(f"SELECT c.read_id, c.position, CASE WHEN x.site_type IN ('GpC', 'ambiguous_GpC_CpG') THEN c.call END AS gpc, CASE WHEN x.site_type IN ('CpG', 'ambiguous_GpC_CpG') THEN c.call END AS cpg, CASE WHEN x.site_type = 'other_C' THEN c.call END AS other_c FROM $calls c JOIN {CONTEXT} x ON x.reference = c.reference AND x.position = c.position")
def scalar_site_type_layers(t: Tables):
    sites = grid.base_context(t.references).select("reference", "position", "site_type")
    rows = t.calls.join(sites, ["reference", "position"])
    on = lambda *k: F.when(F.col("site_type").isin(*k), F.col("call"))
    return rows.select("read_id", "position", on("GpC", "ambiguous_GpC_CpG").alias("gpc"), on("CpG", "ambiguous_GpC_CpG").alias("cpg"), on("other_C").alias("other_c"))


@query("SELECT read_id, position, CASE WHEN signal > 0.055 THEN 1 WHEN signal IS NOT NULL THEN 0 END AS binary FROM $calls")
def scalar_binarize(t: Tables):
    return t.calls.select("read_id", "position", F.when(F.col("signal") > 0.055, 1).when(F.col("signal").isNotNull(), 0).alias("binary"))


@query("WITH th AS (SELECT reference, position, round(avg(signal), 9) AS threshold, round(avg(signal), 9) > 0.05 AS ok FROM $calls GROUP BY 1, 2) SELECT c.read_id, c.position, CASE WHEN th.ok THEN CASE WHEN c.signal > th.threshold THEN 1 ELSE 0 END END AS binary FROM $calls c JOIN th ON th.reference = c.reference AND th.position = c.position")
def scalar_binarize_thresholds(t: Tables):
    th = t.calls.groupBy("reference", "position").agg(F.round(F.avg("signal"), 9).alias("threshold"), (F.round(F.avg("signal"), 9) > 0.05).alias("ok"))
    return t.calls.join(th, ["reference", "position"]).select("read_id", "position", F.when(F.col("ok"), (F.col("signal") > F.col("threshold")).cast("int")).alias("binary"))


@query("SELECT reference, position, CASE reference WHEN 'refA' THEN position - 30 ELSE -(position - 12) END AS reindexed, max(position) OVER (PARTITION BY reference) + min(position) OVER (PARTITION BY reference) - position AS inverted FROM (SELECT DISTINCT reference, position FROM $calls)")
def scalar_reindex_invert(t: Tables):
    rows = t.calls.select("reference", "position").distinct()
    w = Window.partitionBy("reference")
    sign = F.when(F.col("reference") == "refA", F.col("position") - 30).otherwise(-(F.col("position") - 12))
    return rows.select("reference", "position", sign.alias("reindexed"), (F.max("position").over(w) + F.min("position").over(w) - F.col("position")).alias("inverted"))


@query("SELECT read_id, position, CASE WHEN call IS NULL THEN NULL WHEN mismatch = 1 THEN 2 WHEN call = 1 THEN 1 ELSE 0 END AS combined, call IS NULL AS nan_mask FROM $calls")
def scalar_combine_layers(t: Tables):
    c = F.when(F.col("call").isNull(), F.lit(None)).when(F.col("mismatch") == 1, 2).when(F.col("call") == 1, 1).otherwise(0)
    return t.calls.select("read_id", "position", c.alias("combined"), F.col("call").isNull().alias("nan_mask"))


UMI_REASON = """CASE WHEN u IS NULL THEN 'missing' WHEN u = '' THEN 'empty' WHEN length(u) <> 8 THEN 'wrong_length_' || CAST(length(u) AS VARCHAR) WHEN contains(u, 'N') THEN 'contains_N' WHEN list_max([length(u) - length(replace(u, x, '')) FOR x IN ['A', 'C', 'G', 'T', 'N']]) / 8.0 > 0.4 THEN 'high_homopolymer_fraction' WHEN len(list_distinct(string_split(u, ''))) < 3 THEN 'low_complexity' WHEN regexp_matches(u, 'AAA|CCC|GGG|TTT') THEN 'homopolymer_run_gt2' END"""


@query(f"SELECT read_id, {UMI_REASON} AS reason FROM (SELECT read_id, CASE WHEN read_id % 31 = 0 THEN NULL WHEN read_id % 29 = 0 THEN '' WHEN read_id % 23 = 0 THEN umi1 || 'A' ELSE umi1 END AS u FROM $umis)")
def scalar_umi_validation(t: Tables):
    u = F.when(F.col("read_id") % 31 == 0, F.lit(None)).when(F.col("read_id") % 29 == 0, "").when(F.col("read_id") % 23 == 0, F.concat("umi1", F.lit("A"))).otherwise(F.col("umi1"))
    return t.umis.select("read_id", S.umi_failure(u, 8, max_fraction=0.4, min_unique=3, max_run=2).alias("reason"))


@query("SELECT read_id, round(-list_sum([CASE WHEN k > 0 THEN k / n * log2(k / n) ELSE 0 END FOR k IN ks]), 6) AS entropy, round(list_max(ks) / length(u), 6) AS homopolymer FROM (SELECT read_id, u, ks, list_sum(ks) AS n FROM (SELECT read_id, umi2 AS u, [CAST(length(umi2) - length(replace(umi2, x, '')) AS DOUBLE) FOR x IN ['A', 'C', 'G', 'T']] AS ks FROM $umis))")
def scalar_umi_entropy(t: Tables):
    return t.umis.select("read_id", F.round(S.entropy(F.col("umi2")), 6).alias("entropy"), F.round(S.homopolymer_fraction(F.col("umi2")), 6).alias("homopolymer"))


@query("SELECT read_id, round(CASE WHEN p IN (0, 1) THEN 0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END, 6) AS entropy FROM (SELECT read_id, avg(call) AS p FROM $calls WHERE call IS NOT NULL GROUP BY 1)")
def scalar_row_entropy(t: Tables):
    p = F.col("p")
    per = t.calls.where("call is not null").groupBy("read_id").agg(F.avg("call").alias("p"))
    return per.select("read_id", F.round(F.when(p.isin(0.0, 1.0), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p)), 6).alias("entropy"))


@query("""SELECT read_id, status, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE least(greatest(CASE WHEN d >= 60 THEN (d - 60) / 40.0 ELSE (60 - d) / 60.0 END, 0), 1) END, 9) AS confidence FROM (SELECT *, CASE WHEN a >= 60 AND b >= 60 THEN 'double' WHEN a >= 60 OR b >= 60 THEN 'single' ELSE 'unclassified' END AS status, CASE WHEN a >= 60 AND b >= 60 THEN least(a, b) ELSE greatest(a, b) END AS d FROM (SELECT o_orderkey AS read_id, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 101 END AS a, o_custkey % 103 AS b FROM orders))""")
def scalar_end_status(t: Tables):
    a = F.when(F.col("o_orderkey") % 13 > 0, F.col("o_orderkey") % 101)
    s = S.end_status(a, F.col("o_custkey") % 103, 60)
    return t.orders.select(F.col("o_orderkey").alias("read_id"), s["status"].alias("status"), F.round(s["confidence"], 9).alias("confidence"))


@query("SELECT doc_id, round(ln(least(greatest(score, 0.001), 0.999) / (1 - least(greatest(score, 0.001), 0.999))), 6) AS logit FROM $predictions")
def scalar_logit(t: Tables):
    return t.predictions.select("doc_id", F.round(S.logit(F.col("score"), 0.001), 6).alias("logit"))


@query("SELECT c.reference, c.position, round((m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w + 1e-9), 6) AS normalized FROM (SELECT reference, position, avg(call) AS m FROM $calls GROUP BY 1, 2) c WINDOW w AS (PARTITION BY reference)")
def scalar_normalized_mean(t: Tables):
    m = t.calls.groupBy("reference", "position").agg(F.avg("call").alias("m"))
    w = Window.partitionBy("reference")
    return m.select("reference", "position", F.round((F.col("m") - F.min("m").over(w)) / (F.max("m").over(w) - F.min("m").over(w) + 1e-9), 6).alias("normalized"))


@query("SELECT reference, position, substr('ACGT', CAST(l_suppkey % 4 + 1 AS INT), 1) AS observed, base, CASE WHEN base = 'C' AND substr('ACGT', CAST(l_suppkey % 4 + 1 AS INT), 1) = 'T' THEN 0 WHEN base = 'C' AND substr('ACGT', CAST(l_suppkey % 4 + 1 AS INT), 1) = 'C' THEN 1 END AS call, count(*) AS n FROM lineitem JOIN " + CONTEXT + " ON position = l_partkey % 600 WHERE reference = 'refA' GROUP BY ALL")
def scalar_conversion_calls(t: Tables):
    bases = grid.base_context(t.references).where("reference = 'refA'").select("reference", "position", "base")
    rows = t.lineitem.select((F.col("l_partkey") % 600).alias("position"), F.substring(F.lit("ACGT"), (F.col("l_suppkey") % 4 + 1).cast("int"), F.lit(1)).alias("observed")).join(bases, "position")
    rows = rows.withColumn("call", S.conversion_call(F.col("base"), F.col("observed"), "conversion", "top"))
    return rows.groupBy("reference", "position", "observed", "base", "call").agg(F.count("*").alias("n"))


@query("SELECT reference, replace(sequence, 'C', 'T') AS top, replace(sequence, 'G', 'A') AS bottom, substr(sequence, 101, 50) AS region FROM $references")
def scalar_converted_references(t: Tables):
    s = F.col("sequence")
    return t.references.select("reference", F.translate(s, "C", "T").alias("top"), F.translate(s, "G", "A").alias("bottom"), F.substring(s, 101, 50).alias("region"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 65 THEN 'both' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 30 THEN 'read_start_only' ELSE 'unclassified' END AS demux FROM events""")
def scalar_json_tags(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", k.alias("k"), F.when(k >= 65, "both").when(k >= 30, "read_start_only").otherwise("unclassified").alias("demux"))


@query("""WITH b AS (SELECT n_nationkey AS id, substr(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 6) AS code FROM nation), r AS (SELECT c_custkey AS read_id, substr(translate(md5(c_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 6) AS seq FROM customer), d AS (SELECT read_id, id, levenshtein(seq, code) AS d FROM r, b), k AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY d, id) AS o, lead(d) OVER (PARTITION BY read_id ORDER BY d, id) AS nxt FROM d)
SELECT read_id, id AS barcode, CAST(d AS INT) AS distance FROM k WHERE o = 1 AND d <= 3 AND nxt - d >= 1""")
def scalar_barcode_assignment(t: Tables):
    def letters(c):
        return F.substring(F.translate(F.md5(F.col(c).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 6)

    codes = t.nation.select(F.col("n_nationkey").alias("id"), letters("n_name").alias("code"))
    reads = t.customer.select(F.col("c_custkey").alias("read_id"), letters("c_name").alias("seq"))
    listed = F.broadcast(codes.agg(F.array_sort(F.collect_list(F.struct("id", "code"))).alias("codes")))
    ranked = F.array_sort(F.transform("codes", lambda x: F.struct(F.levenshtein(F.col("seq"), x["code"]).alias("d"), x["id"].alias("id"))))
    rows = reads.crossJoin(listed).select("read_id", ranked.alias("r")).where("r[0].d <= 3 and r[1].d - r[0].d >= 1")
    return rows.select("read_id", F.col("r")[0]["id"].alias("barcode"), F.col("r")[0]["d"].alias("distance"))


@query("SELECT doc_id, strpos(text, 'the') AS at, CASE WHEN strpos(text, 'the') > 0 THEN substr(text, strpos(text, 'the') + 3, 8) END AS after FROM documents")
def scalar_flank_extract(t: Tables):
    at = F.instr("text", "the")
    return t.documents.select("doc_id", at.cast("long").alias("at"), F.when(at > 0, F.substring(F.col("text"), at + 3, F.lit(8))).alias("after"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, o_orderdate < TIMESTAMP '1998-01-01' AS prunable FROM orders")
def scalar_dates(t: Tables):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"), (F.col("o_orderdate") < F.expr("timestamp_ntz '1998-01-01'")).alias("prunable"))


@query("SELECT read_id, coalesce(arg_max(k, -p) FILTER (call = 1 AND position < 12), 'None') AS class FROM (SELECT read_id, position, call, CASE WHEN position < 4 THEN 'NDR' WHEN position < 8 THEN 'patch' ELSE 'closed' END AS k, CASE WHEN position < 4 THEN 1 WHEN position < 8 THEN 2 ELSE 3 END AS p FROM $calls) GROUP BY 1")
def scalar_classify_position(t: Tables):
    k = F.when(F.col("position") < 4, "NDR").when(F.col("position") < 8, "patch").otherwise("closed")
    p = F.when(F.col("position") < 4, 1).when(F.col("position") < 8, 2).otherwise(3)
    hit = F.when((F.col("call") == 1) & (F.col("position") < 12), F.struct(p.alias("p"), k.alias("k")))
    return t.calls.groupBy("read_id").agg(F.coalesce(F.min(hit)["k"], F.lit("None")).alias("class"))
