"""Connected components of a large edge table by alternating neighbourhood minima, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.sources.shared import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that it reaches.

    Each round links a node's larger neighbours, and then its smaller ones, to the smallest of them;
    paths shorten geometrically, and a round's table is written before the next reads it.  The tables'
    checksums, taken as they are written, tell when nothing changes any more; only then the rounds end.
    A hot node's neighbours only meet in a minimum, which is combined before the shuffle, and in a join
    that adaptive execution can split.
    """

    def put(rows: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = cut_lineage(rows.where("u <> v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        return out, (seen.get["n"], seen.get["s"])

    now, was = put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large, _ = put(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now, is_ = put(large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v"))
        if is_ == was:
            break
        was = is_
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
