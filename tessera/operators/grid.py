"""The reference grid: tiles, context, masks, consensus of paired segments, and stage joins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chimera_mask(ct: Column, ga: Column, purity: Column, *, min_events: int = 3, min_purity: float = 0.9, max_single: float = 0.8) -> Column:
    """Reads with events of both strands, in pure segments, neither strand with nearly all events."""
    total = ct + ga
    single = F.when(total == 0, F.lit(1.0)).otherwise(F.try_divide(F.greatest(ct, ga).cast("double"), total))
    return F.coalesce((ct >= min_events) & (ga >= min_events) & (purity >= min_purity) & (single <= max_single), F.lit(False))


def any_of(df: DataFrame, pattern: str) -> Column:
    """OR of the boolean columns whose names match; null is false; none at all is false."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in df.columns if re.search(pattern, c)], F.lit(False))


def join_stages(stages: list[DataFrame], key: str) -> DataFrame:
    """Inner join of all stages on key, earliest first; columns that an earlier stage has are dropped from later ones."""
    out = stages[0]
    for stage in stages[1:]:
        out = out.join(stage.select(key, *[c for c in stage.columns if c not in out.columns]), key)
    return out


def member_flag(rows: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    found = members.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(found, key, "left").fillna(False, [flag])


def tiles(references: DataFrame, length: str, tile: int, halo: int) -> DataFrame:
    """Core bounds of tiles and their load bounds with a halo, clipped to the reference."""
    rows = references.select("reference", F.col(length).cast("long").alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(length) - 1) / tile))).alias("tile"))
    start = F.col("tile") * tile
    return rows.select("reference", "tile", start.alias("core_start"), F.least(start + tile, F.col("_n")).alias("core_end"), F.greatest(start - halo, F.lit(0)).alias("load_start"), F.least(start + tile + halo, F.col("_n")).alias("load_end"))


def bases(references: DataFrame) -> DataFrame:
    """One row for each reference position with its base and neighbours."""
    rows = references.select("reference", F.posexplode(F.split("sequence", "")).alias("position", "base"), F.length("sequence").alias("_n"), F.col("sequence").alias("_s"))
    before = F.when(F.col("position") > 0, F.substring(F.col("_s"), F.col("position"), F.lit(1)))
    after = F.when(F.col("position") < F.col("_n") - 1, F.substring(F.col("_s"), F.col("position") + 2, F.lit(1)))
    return rows.select("reference", F.col("position").cast("long").alias("position"), "base", before.alias("before"), after.alias("after"))


def base_context(references: DataFrame, strand: str = "top") -> DataFrame:
    """Site type of each interior position by its three-base context; the bottom strand mirrors the rules on G."""
    rows = bases(references)
    c, g, prev, nxt = ("C", "G", "before", "after") if strand == "top" else ("G", "C", "after", "before")
    is_c, gp, cp = F.col("base") == c, F.col(prev) == g, F.col(nxt) == g
    interior = F.col("before").isNotNull() & F.col("after").isNotNull()
    kind = F.when(~interior, F.lit(None)).when(is_c & gp & cp, "ambiguous_GpC_CpG").when(is_c & gp, "GpC").when(is_c & cp, "CpG").when(is_c, "other_C").when(F.col("base") == ("A" if strand == "top" else "T"), "A")
    return rows.select("reference", "position", "base", kind.alias("site_type"))


def paired_consensus(rows: DataFrame, keys: tuple[str, ...] = ("molecule", "position")) -> DataFrame:
    """Mates of a molecule at a position as one: agreeing signals kept, others null with a conflict flag; the base of higher quality, N on a tie of different bases."""
    best = F.max(F.struct("quality", "base"))
    top = rows.groupBy(*keys).agg(F.count("signal").alias("mates"), F.min("signal").alias("lo"), F.max("signal").alias("hi"), best.alias("best"), F.max("quality").alias("q"), F.collect_set(F.struct("quality", "base")).alias("all"))
    tied = F.size(F.array_distinct(F.transform(F.filter("all", lambda x: x["quality"] == F.col("q")), lambda x: x["base"]))) > 1
    same = F.col("lo") == F.col("hi")
    return top.select(*keys, F.col("mates").cast("long").alias("mates"), F.when(same, F.col("lo")).alias("signal"), F.coalesce(~same, F.lit(False)).alias("conflict"), F.when(tied, "N").otherwise(F.col("best.base")).alias("base"))


def collapse_segments(segments: DataFrame, key: str = "molecule") -> DataFrame:
    """One row for each molecule: number of segments, pair state, extent, and whether references are mixed."""
    made = segments.groupBy(key).agg(F.count("*").alias("segment_count"), F.min("reference_start").alias("reference_start"), F.max("reference_end").alias("reference_end"), F.count_distinct("reference").alias("refs"), F.min_by("reference", F.struct("reference_start", "read_id")).alias("reference"))
    state = F.when(F.col("segment_count") == 1, "single").when(F.col("refs") > 1, "discordant").when(F.col("segment_count") == 2, "proper_pair").otherwise("multiple")
    return made.select(key, "segment_count", state.alias("pair_state"), "reference_start", "reference_end", (F.col("refs") > 1).alias("mixed_reference"), "reference")


def chunked(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], size: int) -> DataFrame:
    """Tasks of at most `size` rows within a group, in order."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("chunk", F.floor((n - 1) / size))


def coverage_steps(spans: DataFrame, keys: tuple[str, ...], start: str, end: str) -> DataFrame:
    """Coverage as half-open runs of constant depth (bedGraph): +1 and -1 events, running sum, empty runs dropped."""
    events = spans.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("start")
    depth = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = events.select(*keys, "start", F.lead("start").over(w).alias("end"), depth.alias("depth"))
    return runs.where("end is not null and depth > 0")


def binned_coverage(spans: DataFrame, keys: tuple[str, ...], start: str, end: str, width: int) -> DataFrame:
    """Covered bases by fixed bins."""
    rows = spans.where(F.col(start) < F.col(end)).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))).alias("bin"))
    inside = F.least(F.col("_e"), (F.col("bin") + 1) * width) - F.greatest(F.col("_s"), F.col("bin") * width)
    return rows.groupBy(*keys, "bin").agg(F.sum(inside).alias("covered"), F.count("*").alias("spans"))
