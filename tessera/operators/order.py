"""Ranks over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import cut_lineage


def global_rank(rows: DataFrame, *order: str, out: str = "rank") -> DataFrame:
    """row_number over the whole table in the order of unique keys.

    Rows are dealt by ranges of the order and written once; the ranges are counted, the counts (one a
    range) are prefix-summed, and rows are numbered inside their range.
    """
    dealt = cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_k", inside).join(F.broadcast(starts), "_part").withColumn(out, F.col("_ahead") + F.col("_k")).drop("_part", "_k", "_ahead")


def tile(rank: Column, total: Column, n: int) -> Column:
    """ntile of a rank from 1: the first total % n tiles hold one row more."""
    size, more = F.floor(total / n), total % n
    wide = more * (size + 1)
    return F.when(rank <= wide, F.floor((rank - 1) / (size + 1))).otherwise(more + F.floor((rank - 1 - wide) / F.greatest(size, F.lit(1)))) + 1
