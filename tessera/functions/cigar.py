"""Run-length alignment programs (CIGAR strings) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPERATION = r"(\d+)([MIDNSHP=X])"
#: Operations that consume the read and the reference.
QUERY, REFERENCE = ("M", "I", "S", "=", "X"), ("M", "D", "N", "=", "X")


def operations(cigar: Column) -> Column:
    """array<struct<n, op>>"""
    n = F.regexp_extract_all(cigar, F.lit(OPERATION), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(OPERATION), F.lit(2))
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("bigint").alias("n"), b.alias("op")))


def _total(cigar: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(operations(cigar), F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["op"].isin(*kinds), x["n"]).otherwise(0))


def query_length(cigar: Column) -> Column:
    return _total(cigar, QUERY)


def reference_length(cigar: Column) -> Column:
    return _total(cigar, REFERENCE)


def longest(cigar: Column, op: str) -> Column:
    """The longest run of an operation, 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(F.filter(operations(cigar), lambda x: x["op"] == op), lambda x: x["n"])), F.lit(0).cast("bigint"))


def placed(cigar: Column, start: Column) -> Column:
    """Operations with the read and reference positions at which they begin."""
    zero = F.struct(F.lit(0).cast("bigint").alias("q"), start.cast("bigint").alias("r"), F.array().cast("array<struct<n:bigint,op:string,q:bigint,r:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        one = F.array(F.struct(x["n"].alias("n"), x["op"].alias("op"), a["q"].alias("q"), a["r"].alias("r")))
        return F.struct((a["q"] + F.when(x["op"].isin(*QUERY), x["n"]).otherwise(0)).alias("q"), (a["r"] + F.when(x["op"].isin(*REFERENCE), x["n"]).otherwise(0)).alias("r"), F.concat(a["out"], one).alias("out"))

    return F.aggregate(operations(cigar), zero, step, lambda a: a["out"])


def aligned_pairs(segments: DataFrame, cigar: str = "cigar", start: str = "reference_start") -> DataFrame:
    """A row for each base on the reference grid: query_position (from 0) and position."""
    blocks = segments.withColumn("_b", F.explode(F.filter(placed(F.col(cigar), F.col(start)), lambda x: x["op"].isin("M", "=", "X"))))
    rows = blocks.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_b.n") - 1)))
    return rows.withColumn("query_position", F.col("_b.q") + F.col("_i")).withColumn("position", F.col("_b.r") + F.col("_i")).drop("_b", "_i")


def scatter(segments: DataFrame, sequence: str = "sequence", window: tuple[int, int] | None = None) -> DataFrame:
    """Bases of segments on the reference grid, within a half-open window; whole segments outside it are dropped before they are expanded."""
    if window:
        lo, hi = window
        segments = segments.where((F.col("reference_start") < hi) & (F.col("reference_start") + reference_length(F.col("cigar")) > lo))
    rows = aligned_pairs(segments).withColumn("base", F.substring(F.col(sequence), (F.col("query_position") + 1).cast("int"), F.lit(1)))
    if window:
        rows = rows.where((F.col("position") >= lo) & (F.col("position") < hi))
    return rows


def inconsistent(segments: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Segments that break the store's rules, with the first reason."""
    reason = F.when(F.col("read_id").isNull(), "missing_read_id").when(F.col("cigar").isNull() | (F.regexp_replace("cigar", OPERATION, "") != ""), "malformed_cigar").when(query_length(F.col("cigar")) != F.length(sequence), "length_mismatch").when(F.count("*").over(Window.partitionBy("read_id")) > 1, "duplicate_read_id")
    return segments.withColumn("reason", reason).where("reason is not null")
