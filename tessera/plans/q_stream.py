"""Streaming and incremental queries.  Streams run to the end of what is there; where a batch form exists the SQL side checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir
from tessera.plans.registry import Tables, query
from tessera.streaming import append, windows


def _stream(t: Tables):
    return windows.file_stream(t.spark, f"{t.sf_dir}/events.parquet")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t: Tables):
    made = windows.tumbling(t.events, "1 day", ("event_type",))
    return made.withColumn("total", F.round("total", 4))


@query("SELECT CAST(s AS TIMESTAMP) AS window_start, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1")
def stream_sliding(t: Tables):
    return windows.sliding(t.events, "12 hours", "6 hours").withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, min(ts) AS session_start, count(*) AS n, max(value) AS peak FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS nw FROM events)) GROUP BY user_id, s")
def stream_sessions(t: Tables):
    return windows.sessions(t.events, "1 hour", ("user_id",))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_complete(t: Tables):
    """The same aggregate as a stream in complete mode."""
    made = windows.tumbling(_stream(t), "1 day", ("event_type",))
    return windows.drained(made, f"{shared_dir(t.spark)}/tessera/streams", "complete").withColumn("total", F.round("total", 4))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_append_ingest(t: Tables):
    """Files ingested exactly once by the file source and its checkpoint."""
    out = windows.drained(_stream(t), f"{shared_dir(t.spark)}/tessera/streams")
    return out.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query()
def stream_deduplicated(t: Tables):
    """First events of each user and type within an hour's watermark."""
    return windows.drained(windows.deduplicated(_stream(t), ["user_id", "event_type"]), f"{shared_dir(t.spark)}/tessera/streams").select("event_id", "user_id", "event_type")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_running_totals(t: Tables):
    """Totals kept in state across batches."""
    rows = windows.drained(windows.running_totals(_stream(t), "user_id", "value"), f"{shared_dir(t.spark)}/tessera/streams", "update")
    best = rows.groupBy("user_id").agg(F.max(F.struct("n", "total")).alias("s"))
    return best.select("user_id", "s.n", F.round("s.total", 4).alias("total"))


@query("SELECT o_orderkey AS read_id, o_totalprice AS value FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 1")
def stream_append_new_rows(t: Tables):
    """Rows of an arriving batch that the table does not hold yet."""
    rows = t.orders.select(F.col("o_orderkey").alias("read_id"), F.col("o_totalprice").alias("value"))
    return append.new_rows(rows.where("read_id % 2 = 0"), rows.where("read_id % 3 = 0").union(rows.where("read_id % 9 = 0")), "read_id").select("read_id", "value")


@query("SELECT 'append_only' AS grown, 'content_mutated' AS changed, 'identical' AS same, 'removed' AS shrunk")
def stream_append_plan(t: Tables):
    rows = t.customer.select("c_custkey", F.sha2(F.col("c_name").cast("binary"), 256).alias("h"))
    half = rows.where("c_custkey % 2 = 0")
    other = half.withColumn("h", F.when(F.col("c_custkey") == 4, "x").otherwise(F.col("h")))
    kind = lambda a, b: append.transition(a, b, "c_custkey", "h")
    return t.spark.createDataFrame([(kind(half, rows), kind(half, other), kind(half, half), kind(rows, half))], "grown string, changed string, same string, shrunk string")


@query("SELECT count(*) AS unseen FROM (SELECT DISTINCT o_orderkey FROM orders) ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem) x USING (o_orderkey)")
def stream_completeness(t: Tables):
    """Selected reads that no chunk brought."""
    return t.orders.select("o_orderkey").distinct().join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").agg(F.count("*").alias("unseen"))


@query("SELECT CAST((l_orderkey * 7919 + 42 * 104729) % 1000003 % 4 AS BIGINT) AS worker, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1")
def stream_worker_batches(t: Tables):
    """Deterministic shards of a read, each with mergeable moments."""
    worker = (F.col("l_orderkey") * 7919 + 42 * 104729) % 1000003 % 4
    return t.lineitem.groupBy(worker.alias("worker")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("std"))


@query("SELECT 0 AS removed, 0 AS changed, CAST(count(*) AS INT) AS new FROM customer WHERE c_custkey >= 700")
def stream_growth_check(t: Tables):
    rows = t.customer.select("c_custkey", F.md5(F.col("c_name").cast("binary")).alias("h"))
    r = append.grown(rows.where("c_custkey < 700"), rows, "c_custkey", "h")
    return t.spark.createDataFrame([(r["removed"], r["changed"], r["new"])], "removed int, changed int, new int")
