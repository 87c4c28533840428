"""Queries along ordered axes, sorts, limits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import grid, islands
from tessera.plans.registry import Tables, query

KEY = ("user_id",)
RUNS = """(SELECT user_id, value, min(position) AS start, max(position) + 1 AS "end", count(*) AS n FROM (SELECT user_id, position, call AS value, position - row_number() OVER (PARTITION BY user_id, call ORDER BY position) AS g FROM $track WHERE call IS NOT NULL) GROUP BY user_id, value, g)"""


def _runs(t: Tables):
    return islands.runs(t.track, KEY, "position", F.col("call"))


@query("""SELECT user_id, position, coalesce(last_value(call IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(call IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM $track""")
def win_fill_closest(t: Tables):
    return islands.fill_closest(t.track, KEY, "position", "call", "filled").select("user_id", "position", "filled")


@query("SELECT user_id, position, CASE WHEN call IS NULL THEN 0 WHEN call = 0 THEN -1 ELSE call END AS nan0_0minus1, CASE WHEN call IS NULL THEN 1 WHEN call = 1 THEN 2 ELSE call END AS nan1_12, coalesce(call, -1) AS nan_minus_1, coalesce(CAST(call AS DOUBLE), 0.5) AS nan_half FROM $track")
def win_missing_encodings(t: Tables):
    return t.track.select("user_id", "position", *[c.alias(n) for n, c in islands.encodings(F.col("call")).items()])


@query(f'SELECT * FROM {RUNS}')
def win_runs(t: Tables):
    return _runs(t)


@query("""SELECT user_id, position, CASE WHEN call = 1 THEN count(*) FILTER (call = 1) OVER (PARTITION BY user_id, g) ELSE 0 END AS run_length FROM (SELECT user_id, position, call, sum(CASE WHEN call = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY position) AS g FROM $track)""")
def win_run_lengths(t: Tables):
    return islands.run_lengths(t.track, KEY, "position", "call").select("user_id", "position", "run_length")


@query(f"""SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS parts FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY start) AS s FROM (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY user_id ORDER BY start) <= 2 THEN 0 ELSE 1 END AS nw FROM {RUNS} WHERE value = 1)) GROUP BY user_id, s""")
def win_merge_runs(t: Tables):
    return islands.merge_runs(_runs(t).where("value = 1").select("user_id", "start", "end"), KEY, 2)


@query(f"""SELECT user_id, CASE WHEN n < 3 THEN 'small' WHEN n < 6 THEN 'medium' ELSE 'large' END AS class, count(*) AS runs, CAST(sum(n) AS BIGINT) AS bases FROM {RUNS} WHERE value = 1 GROUP BY ALL""")
def win_size_classes(t: Tables):
    kind = islands.size_class(F.col("n"), [("small", 0, 3), ("medium", 3, 6), ("large", 6, None)])
    return _runs(t).where("value = 1").groupBy("user_id", kind.alias("class")).agg(F.count("*").alias("runs"), F.sum("n").alias("bases"))


@query("SELECT c.read_id, c.position, CASE WHEN c.position BETWEEN c.read_id % 20 AND c.read_id % 20 + 30 THEN c.call END AS call FROM $calls c")
def win_mask_outside_span(t: Tables):
    lo = F.col("read_id") % 20
    return t.calls.select("read_id", "position", F.when(F.col("position").between(lo, lo + 30), F.col("call")).alias("call"))


@query(f"""SELECT user_id, start, "end" - start AS size, (start + "end" - 1) / 2.0 AS centre, lead((start + "end" - 1) / 2.0) OVER (PARTITION BY user_id ORDER BY start) - (start + "end" - 1) / 2.0 AS to_next FROM {RUNS} WHERE value = 1""")
def win_run_spacing(t: Tables):
    return islands.spacing(_runs(t).where("value = 1").select("user_id", "start", "end"), KEY).select("user_id", "start", "size", "centre", "to_next")


SITES = "(SELECT user_id, position * 5 AS position, CAST(floor(position / 4.0) AS BIGINT) % 3 % 2 + CASE WHEN position % 19 = 0 THEN 1 ELSE 0 END AS call FROM $track WHERE call IS NOT NULL)"
SEGMENTS = f"""(SELECT user_id, segment, member, first, last, sites, coalesce(CAST(floor((lag(last) OVER w + first + 1) / 2.0) AS BIGINT), first) AS start, coalesce(CAST(floor((last + lead(first) OVER w + 1) / 2.0) AS BIGINT), last + 1) AS "end", sites >= 2 AS supported FROM
(SELECT user_id, segment, call AS member, min(position) AS first, max(position) AS last, count(*) AS sites FROM (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY position) AS BIGINT) AS segment FROM (SELECT *, CASE WHEN call = lag(call) OVER (PARTITION BY user_id ORDER BY position) THEN 0 ELSE 1 END AS nw FROM {SITES})) GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY user_id ORDER BY segment))"""


def _sites(t: Tables):
    p = F.col("position")
    call = F.floor(p / 4) % 3 % 2 + F.when(p % 19 == 0, 1).otherwise(0)
    return t.track.where("call is not null").select("user_id", (p * 5).alias("position"), call.cast("long").alias("call"))


@query(f"SELECT * FROM {SEGMENTS}")
def win_variant_segments(t: Tables):
    return islands.variant_segments(_sites(t), KEY, "position", "call")


@query(f"""SELECT user_id, n AS segments, CASE WHEN away = 0 THEN 'none' WHEN n = 1 THEN 'all' WHEN away > 1 THEN 'multi' WHEN a <> 0 AND n = 2 THEN 'left' WHEN b <> 0 AND n = 2 THEN 'right' WHEN n = 3 THEN 'middle' ELSE 'multi' END AS mismatch, program FROM
(SELECT user_id, count(*) AS n, count(*) FILTER (member <> 0) AS away, arg_min(member, segment) AS a, arg_max(member, segment) AS b, string_agg(CAST(sites AS VARCHAR) || CASE WHEN member = 0 THEN 'H' ELSE 'A' END, '' ORDER BY segment) AS program FROM {SEGMENTS} GROUP BY 1)""")
def win_variant_mismatch_type(t: Tables):
    return islands.mismatch_type(islands.variant_segments(_sites(t), KEY, "position", "call"), KEY, 0)


@query("""WITH r AS (SELECT user_id, position, call, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, sum(call) OVER w AS p, sum(call) OVER (PARTITION BY user_id) AS t FROM $track WHERE call IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY position)),
s AS (SELECT *, CASE WHEN k < n THEN greatest(p, k - p) + greatest(t - p, n - k - t + p) END AS s FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC NULLS LAST, k) AS o FROM s)
SELECT user_id, n, CAST(t AS BIGINT) AS plus, round(CASE WHEN n < 2 THEN 1.0 ELSE s / CAST(n AS DOUBLE) END, 9) AS purity, CASE WHEN n < 2 THEN -1 ELSE k END AS split FROM b WHERE o = 1""")
def win_strand_switch(t: Tables):
    made = islands.strand_switch(t.track.where("call is not null"), KEY, "position", "call")
    return made.withColumn("purity", F.round("purity", 9))


@query("SELECT DISTINCT o_orderpriority AS sample, s AS start_row, e AS end_row FROM (SELECT o_orderpriority, min(k) OVER (PARTITION BY o_orderpriority, g) AS s, max(k) OVER (PARTITION BY o_orderpriority, g) + 1 AS e FROM (SELECT o_orderpriority, o_orderkey AS k, o_orderkey - row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS g FROM orders))")
def win_value_ranges(t: Tables):
    rows = t.orders.select(F.lit(1).alias("all"), "o_orderkey", F.col("o_orderpriority").alias("sample"))
    return islands.runs(rows, ("all", "sample"), "o_orderkey", F.lit(1)).select("sample", F.col("start").alias("start_row"), F.col("end").alias("end_row"))


@query("SELECT user_id, position, round(CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END, 6) AS rolling FROM (SELECT user_id, position, CASE WHEN call IS NOT NULL THEN value END AS value FROM $track) WINDOW w AS (PARTITION BY user_id ORDER BY position ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def win_rolling_mean(t: Tables):
    rows = t.track.select("user_id", "position", F.when(F.col("call").isNotNull(), F.col("value")).alias("value"))
    return islands.rolling_mean(rows, KEY, "position", "value", 5, 3).select("user_id", "position", F.round("rolling", 6).alias("rolling"))


@query("""WITH c AS (SELECT read_id, position, call - avg(call) OVER (PARTITION BY read_id) AS x FROM $calls WHERE call IS NOT NULL), s AS (SELECT read_id, sum(x * x) AS ss, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 2 AND sum(x * x) > 1e-12)
SELECT a.read_id, b.position - a.position AS lag, count(*) AS pairs, round(sum(a.x * b.x) / max(ss), 6) + 0.0 AS ac FROM c a JOIN c b ON a.read_id = b.read_id AND b.position - a.position BETWEEN 1 AND 10 JOIN s ON s.read_id = a.read_id GROUP BY 1, 2 UNION ALL SELECT read_id, 0, n, 1.0 FROM s""")
def win_autocorrelation(t: Tables):
    return islands.autocorrelation(t.calls, ("read_id",), "position", "call", 10).withColumn("ac", F.round("ac", 6) + 0.0)


@query("""WITH c AS (SELECT read_id, sample, position, call - avg(call) OVER (PARTITION BY read_id) AS x FROM $calls WHERE call IS NOT NULL), s AS (SELECT read_id, sum(x * x) AS ss, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 2 AND sum(x * x) > 1e-12),
p AS (SELECT a.sample, a.read_id, b.position - a.position AS lag, count(*) AS pairs, (sum(a.x * b.x) / count(*)) / (max(ss) / max(n)) AS ac FROM c a JOIN c b ON a.read_id = b.read_id AND b.position - a.position BETWEEN 1 AND 12 JOIN s ON s.read_id = a.read_id GROUP BY 1, 2, 3)
SELECT sample, lag, CAST(sum(pairs) AS BIGINT) AS weight, round(sum(ac * pairs) / sum(pairs), 6) AS mean FROM p GROUP BY 1, 2""")
def win_mean_autocorrelation(t: Tables):
    from tessera.operators import qc

    ac = islands.autocorrelation(t.calls, ("sample", "read_id"), "position", "call", 12, pearson=True).where("lag > 0")
    return qc.weighted_mean(ac, ("sample", "lag"), "ac", "pairs").withColumn("mean", F.round("mean", 6))


@query("SELECT c.reference, s.range * 5 AS window_start, count(call) AS n_valid, round(avg(call), 9) AS mean FROM $calls c JOIN range(9) s ON c.position >= s.range * 5 AND c.position < s.range * 5 + 20 GROUP BY 1, 2")
def win_sliding_windows(t: Tables):
    rows = islands.sliding(t.calls, "position", 20, 5, 0, 60)
    return rows.groupBy("reference", "window_start").agg(F.count("call").alias("n_valid"), F.round(F.avg("call"), 9).alias("mean"))


@query("""WITH w AS (SELECT c.reference, c.read_id, c.position, c.call, s.range * 10 AS window_start FROM $calls c JOIN range(4) s ON c.position >= s.range * 10 AND c.position < s.range * 10 + 30 WHERE call IS NOT NULL),
c AS (SELECT *, call - avg(call) OVER (PARTITION BY read_id, window_start) AS x FROM w), s AS (SELECT reference, read_id, window_start, sum(x * x) AS ss, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 2 AND sum(x * x) > 1e-12),
p AS (SELECT a.reference, a.read_id, a.window_start, b.position - a.position AS lag, count(*) AS pairs, (sum(a.x * b.x) / count(*)) / (max(ss) / max(n)) AS ac FROM c a JOIN c b ON a.read_id = b.read_id AND a.window_start = b.window_start AND b.position - a.position BETWEEN 1 AND 15 JOIN s ON s.read_id = a.read_id AND s.window_start = a.window_start GROUP BY ALL UNION ALL SELECT reference, read_id, window_start, 0, n, 1.0 FROM s),
m AS (SELECT reference, window_start, count(*) AS molecules FROM s GROUP BY ALL HAVING count(*) >= 10)
SELECT p.reference, p.window_start, lag, molecules, CAST(sum(pairs) AS BIGINT) AS weight, round(sum(ac * pairs) / sum(pairs), 6) + 0.0 AS mean FROM p JOIN m ON m.reference = p.reference AND m.window_start = p.window_start GROUP BY ALL""")
def win_sliding_autocorrelation(t: Tables):
    made = islands.window_autocorrelation(t.calls, ("reference",), "read_id", "position", "call", size=30, step=10, first=0, last=60, max_lag=15)
    return made.withColumn("mean", F.round("mean", 6) + 0.0)


@query("""SELECT user_id, base, point, round(v[lo + 1] + (v[least(lo + 2, n)] - v[lo + 1]) * (x - lo), 6) + 0.0 AS value FROM (SELECT *, CAST(floor(x) AS BIGINT) AS lo FROM (SELECT *, point * (n - 1) / 4.0::DOUBLE AS x FROM (SELECT user_id, base, list(value ORDER BY position) AS v, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY position) AS BIGINT) AS base FROM $track) WHERE base > 0 GROUP BY 1, 2), range(5) j(point)))""")
def win_signal_trace(t: Tables):
    rows = islands.base_ranges(t.track.withColumn("move", F.col("value") > 30), KEY, "position", "move")
    made = islands.resampled_trace(rows, ("user_id", "base"), "position", "value", 5)
    return made.select("user_id", "base", F.posexplode("trace").alias("point", "value")).withColumn("point", F.col("point").cast("long")).withColumn("value", F.round("value", 6) + 0.0)


@query("""SELECT user_id, base, min(position) AS start, count(*) AS dwell, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM (SELECT *, CAST(sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY position) AS BIGINT) AS base FROM $track) WHERE base > 0 GROUP BY 1, 2""")
def win_signal_features(t: Tables):
    rows = islands.base_ranges(t.track.withColumn("move", F.col("value") > 30), KEY, "position", "move")
    return rows.groupBy("user_id", "base").agg(F.min("position").alias("start"), F.count("*").alias("dwell"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS nw FROM events)) GROUP BY user_id, s")
def win_sessions(t: Tables):
    rows = t.events.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("first_ts"), "n")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 2654435761) % 1000003, o_orderkey) AS k FROM orders) WHERE k <= 50")
def topk_subsample_groups(t: Tables):
    k = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy((F.col("o_orderkey") * 2654435761) % 1000003, "o_orderkey"))
    return t.orders.withColumn("k", k).where("k <= 50").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 2654435761) % 1000003, o_orderkey LIMIT 200")
def topk_subsample_global(t: Tables):
    return t.orders.orderBy((F.col("o_orderkey") * 2654435761) % 1000003, "o_orderkey").limit(200).select("o_orderkey")


@query("SELECT o_orderkey AS read_id FROM orders ORDER BY sha256('exp' || chr(1) || CAST(o_orderkey AS VARCHAR) || chr(1) || '42'), o_orderkey LIMIT 100")
def topk_fit_membership(t: Tables):
    key = F.sha2(F.concat_ws("\x01", F.lit("exp"), F.col("o_orderkey").cast("string"), F.lit("42")).cast("binary"), 256)
    return t.orders.orderBy(key, "o_orderkey").limit(100).select(F.col("o_orderkey").alias("read_id"))


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 10")
def topk_largest_per_group(t: Tables):
    k = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"))
    return t.lineitem.withColumn("k", k).where("k <= 10").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT reference, sample, read_id, CAST(floor((row_number() OVER (PARTITION BY reference, sample ORDER BY read_quality DESC NULLS LAST, read_id) - 1) / 500.0) AS BIGINT) AS chunk FROM $molecules")
def topk_duplicate_chunks(t: Tables):
    rows = t.molecules.withColumn("_q", -F.coalesce("read_quality", F.lit(-1.0)))
    return grid.chunked(rows, ("reference", "sample"), ("_q", "read_id"), 500).select("reference", "sample", "read_id", "chunk")


@query("SELECT sample, reference, read_id, rank FROM (SELECT sample, reference, read_id, row_number() OVER (PARTITION BY sample ORDER BY m DESC, reference, read_id) AS rank FROM (SELECT sample, reference, read_id, round(avg(call), 9) AS m FROM $calls WHERE call IS NOT NULL GROUP BY 1, 2, 3)) WHERE rank <= 25")
def topk_clustermap_rows(t: Tables):
    per = t.calls.where("call is not null").groupBy("sample", "reference", "read_id").agg(F.round(F.avg("call"), 9).alias("m"))
    return per.select("sample", "reference", "read_id", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("m"), "reference", "read_id")).alias("rank")).where("rank <= 25")
