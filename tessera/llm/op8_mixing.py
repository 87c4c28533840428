"""Mixing sources to target weights by systematic sampling.

Each source has a target share of all words; no target exceeds `most` times its source's words, and what
a capped source leaves is shared again by weight.  A document's expected copies are its source's target
over its source's size.  Documents stand from large to small: by classes of CLASSES an octave (exact sizes up to
CLASSES words), inside a class by hash bucket, inside a bucket by exact size; expected copies are prefix-summed
along it, one random offset is added for the source, and a document is emitted once for each integer boundary
that its own step crosses: floor or ceiling of its expected copies.  Neighbours differ little in size, so what one
gives too much the next gives too little.  Where a few large documents hold much of a source, whether they are
emitted is left to the offset; so OFFSETS random offsets are tried for each source, in one pass of sums, and the
one whose words come nearest to the target is the source's own.

Prefix sums go over a source's classes, of which there are CLASSES an octave however large it is, then over the
buckets of a class, and rows are ranked inside their bucket only, so a source with a third of all rows is spread
over all buckets.  Targets are computed in the same plan from a row for each source; no row of it is collected.

Defined results: null text has size 0.  A null source comes last and is a source like others.  A source
whose documents hold no words has target 0 and gives nothing.  Equal rows are interchangeable.  Empty
tables give empty ones.  Columns of docs but the three are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import shuffle_buckets, written

WEIGHTS = (5, 2, 1)
MOST = 3.0
CLASSES = 64
OFFSETS = 32
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): targets sum to all sizes, in shares by weight, none above `most` times its size.

    Sources go by code point, null last, with the weights repeating.  A source is capped where the level, the
    target of a unit of weight, would pass its bound (most * size / weight); with the sources in the order of
    their bounds, the level is what the ones before leave over the weight of the others.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    rows = rows.withColumn("bound", most * F.col("source_size") / F.col("weight"))
    in_turn = everything.orderBy("bound", F.col("source").asc_nulls_last())
    spent = most * F.coalesce(F.sum("source_size").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(in_turn.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("turn", F.row_number().over(in_turn)).withColumn("level", (F.sum("source_size").over(everything) - spent) / rest)
    # The level of the first source that it does not pass holds for all after it.
    level = F.min(F.when(F.col("level") <= F.col("bound"), F.struct("turn", "level"))).over(everything)["level"]
    target = F.coalesce(F.least(level * F.col("weight"), most * F.col("source_size")), most * F.col("source_size"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """A row for each row of docs: id, source, hash (of the text), size, source_size, target and copies."""
    spark = docs.sparkSession
    n = shuffle_buckets(spark, 2)
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("hash"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    slim = slim.withColumn("place", F.xxhash64(F.col("id").cast("string"), "hash", "source", F.lit(seed)))
    size = F.col("size")
    slim = slim.withColumn("class", F.when(size <= CLASSES, -size).otherwise(-CLASSES - F.floor(CLASSES * F.log2(size / CLASSES)) - 1).cast("int"))
    slim = written(slim.withColumn("bucket", F.pmod(F.shiftright("place", 20), F.lit(n)).cast("int")), "mixing-sizes")
    counts = slim.groupBy("source", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    plan = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    keyed = F.col("s.source").eqNullSafe(F.col("r.source"))
    above = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    by_class = counts.groupBy("source", "class").agg(F.sum("n").alias("n")).select("source", "class", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    by_class = by_class.alias("r").join(plan.alias("s"), keyed).select("r.*", "s.source_size", "s.target", "s.rate")
    ahead = Window.partitionBy("source", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "class", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    starts = starts.alias("r").join(by_class.alias("s"), keyed & (F.col("s.class") == F.col("r.class"))).select("r.source", "r.class", "r.bucket", (F.col("r.ahead") + F.col("s.above")).alias("ahead"), "s.source_size", "s.target", "s.rate")
    starts = written(starts, "mixing-starts")
    inside = Window.partitionBy("source", "class", "bucket").orderBy(F.desc("size"), "place", "id", "hash")
    ranked = slim.withColumn("rank", F.row_number().over(inside))
    met = keyed & (F.col("s.class") == F.col("r.class")) & (F.col("s.bucket") == F.col("r.bucket"))
    both = written(ranked.alias("r").join(starts.alias("s"), met).select("r.id", "r.source", "r.hash", "r.size", "r.class", "r.bucket", (F.col("s.ahead") + F.col("r.rank")).alias("rank"), "s.rate", "s.target"), "mixing-ranks")

    def offset(k: int):
        return F.pmod(F.xxhash64(F.coalesce("source", F.lit("\x00null")), F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40)

    def copies(at):
        made = F.floor(F.col("rank") * F.col("rate") + at) - F.floor((F.col("rank") - 1) * F.col("rate") + at)
        return F.least(made, F.lit(int(most) if most == int(most) else int(most) + 1)).cast("long")

    tried = both.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(copies(offset(k)) * F.col("size")).alias(f"w{k}") for k in range(OFFSETS)])
    chosen = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("off"), F.lit(k).alias("k"), offset(k).alias("offset")) for k in range(OFFSETS)]))
    best = tried.select("source", chosen["offset"].alias("offset"))
    starts = starts.alias("r").join(best.alias("s"), keyed).select("r.source", "r.class", "r.bucket", "r.source_size", "s.offset")
    out = both.alias("r").join(starts.alias("s"), met).select("r.*", "s.source_size", "s.offset")
    return out.select("id", "source", "hash", "size", "source_size", "target", copies(F.col("offset")).alias("copies"))
