"""Coverage, modification statistics, quality control and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null for a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def coverage(calls: DataFrame, threshold: float, reads: DataFrame | None = None) -> DataFrame:
    """valid_count, valid_fraction and validity of each (reference, position); the denominator is the reference's number of reads."""
    totals = (reads if reads is not None else calls.select("reference", "read_id").distinct()).groupBy("reference").agg(F.count("*").alias("n_reads"))
    per = calls.groupBy("reference", "position").agg(F.count("call").alias("valid_count"))
    return per.join(F.broadcast(totals), "reference").select("reference", "position", "valid_count", "n_reads", ratio(F.col("valid_count"), F.col("n_reads")).alias("valid_fraction"), (ratio(F.col("valid_count"), F.col("n_reads")) >= threshold).alias("position_valid"))


def read_modification(calls: DataFrame, site: Column) -> DataFrame:
    """Per read and site type: modified, observed, fraction; and each fraction over the background type's."""
    per = calls.groupBy("read_id", site.alias("site_type")).agg(F.sum("call").alias("modified"), F.count("call").alias("observed"))
    return per.withColumn("fraction", ratio(F.col("modified"), F.col("observed")))


def background_ratios(per: DataFrame, types: tuple[str, ...], background: str) -> DataFrame:
    wide = per.groupBy("read_id").pivot("site_type", [*types, background]).agg(F.first("fraction"))
    return wide.select("read_id", *[F.col(t).alias(f"fraction_{t}") for t in types], *[ratio(F.col(t), F.col(background)).alias(f"{t}_to_{background}") for t in types])


def length_stats(calls: DataFrame) -> DataFrame:
    """First and last observed position of each read and the length between them."""
    per = calls.where("call is not null").groupBy("read_id").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    return per.withColumn("length", F.col("last") - F.col("first") + 1)


def mismatch_frequency(calls: DataFrame) -> DataFrame:
    """Per (reference, position): mismatch frequency, mean Phred error, and whether the first exceeds the second."""
    per = calls.groupBy("reference", "position").agg(F.count("*").alias("covered"), F.sum("mismatch").alias("mismatches"), F.avg(F.pow(F.lit(10.0), -F.col("quality") / 10)).alias("mean_error"))
    freq = ratio(F.col("mismatches"), F.col("covered"))
    return per.withColumn("frequency", freq).withColumn("variable", freq > F.col("mean_error"))


def quality_stats(calls: DataFrame) -> DataFrame:
    error = F.pow(F.lit(10.0), -F.col("quality") / 10)
    return calls.where("quality >= 0").groupBy("reference", "position").agg(F.avg("quality").alias("mean_quality"), F.stddev_pop("quality").alias("std_quality"), F.avg(error).alias("mean_error"), F.stddev_pop(error).alias("std_error"))


def consensus(rows: DataFrame, keys: tuple[str, ...], base: str, order: str = "ACGTN") -> DataFrame:
    """The commonest base of each key; ties go to the first in `order`."""
    counted = rows.groupBy(*keys, base).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.max_by(base, F.struct("_n", -F.instr(F.lit(order), F.col(base)))).alias("consensus"), F.max("_n").alias("support"))


def merged_metrics(tasks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Task metrics as one: sums of reads, valid and modified calls, the greatest number of sites, and the mean of all calls."""
    per = tasks.groupBy(*keys).agg(F.sum("n_reads").alias("n_reads"), F.sum("n_valid").alias("n_valid"), F.sum("modified_sum").alias("modified_sum"), F.max("n_site_positions").alias("n_site_positions"))
    return per.withColumn("mean", ratio(F.col("modified_sum"), F.col("n_valid")))


def weighted_mean(rows: DataFrame, keys: tuple[str, ...], value: str, weight: str, least: float = 1) -> DataFrame:
    """Weighted mean; a missing value adds nothing above but its weight below; null under `least` total weight."""
    per = rows.groupBy(*keys).agg(F.sum(F.coalesce(F.col(value) * F.col(weight), F.lit(0.0))).alias("_t"), F.sum(weight).alias("weight"))
    return per.select(*keys, "weight", F.when(F.col("weight") >= least, ratio(F.col("_t"), F.col("weight"))).alias("mean"))


def cohort_metrics(obs: DataFrame, cohorts: dict[str, Column], flags: dict[str, Column], by: tuple[str, str]) -> DataFrame:
    """Rates of flags within cohorts, overall, by each of two keys, and by both: grouping sets over exploded cohort membership."""
    tagged = obs.withColumn("cohort", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in cohorts.items()]), lambda x: x.isNotNull())))
    a, b = by
    sets = tagged.groupingSets([["cohort"], ["cohort", a], ["cohort", b], ["cohort", a, b]], "cohort", a, b)
    made = sets.agg(F.grouping_id().alias("_g"), F.count("*").alias("denominator"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in flags.items()])
    long = made.select("cohort", a, b, "_g", "denominator", F.explode(F.create_map(*[x for n in flags for x in (F.lit(n), F.col(n))])).alias("metric", "numerator"))
    scope = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, a).when(F.col("_g") == 2, b).otherwise(f"{a}_{b}")
    return long.select("cohort", scope.alias("scope"), a, b, "metric", "numerator", "denominator", ratio(F.col("numerator"), F.col("denominator")).alias("rate"))


def complexity_curve(rows: DataFrame, group: tuple[str, ...], cluster: str, key: str, depths: int, prime: int = 1000003) -> DataFrame:
    """Distinct clusters among the first k-th part of rows in an order by an arithmetic hash, for each k."""
    mixed = (F.col(key) * 7919 + 104729) % prime
    staged = rows.select(*group, cluster, F.explode(F.sequence(F.floor(mixed * depths / prime).cast("long"), F.lit(depths - 1))).alias("depth"))
    return staged.groupBy(*group, "depth").agg(F.count("*").alias("reads"), F.count_distinct(cluster).alias("unique"))


def saturation(unique: float, reads: float) -> float:
    """C0 of unique = C0 (1 - exp(-reads / C0)), by bisection; the observed number where the curve is flat."""
    import math

    if unique >= reads:
        return 1e12
    lo, hi = max(1.0, unique), 1e12
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        if mid * -math.expm1(-reads / mid) < unique:
            lo = mid
        else:
            hi = mid
    return lo


def bipartite(rows: DataFrame, u: str, v: str, group: tuple[str, ...]) -> DataFrame:
    """Edges of a two-sided barcode graph: counts, share of either side, and whether each is the other's strongest partner (ties to the smaller)."""
    e = rows.groupBy(*group, u, v).agg(F.count("*").alias("edges"))
    by_u, by_v = Window.partitionBy(*group, u), Window.partitionBy(*group, v)
    best_u = F.row_number().over(by_u.orderBy(F.desc("edges"), v)) == 1
    best_v = F.row_number().over(by_v.orderBy(F.desc("edges"), u)) == 1
    return e.select(*group, u, v, "edges", ratio(F.col("edges"), F.sum("edges").over(by_u)).alias("fidelity_u"), ratio(F.col("edges"), F.sum("edges").over(by_v)).alias("fidelity_v"), (best_u & best_v).alias("mutual"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Classes of two labels after trimming and folding case."""
    x, y = F.lower(F.trim(F.col(a))), F.lower(F.trim(F.col(b)))
    nothing = lambda c: c.isNull() | (c == "") | (c == "unclassified")
    kind = F.when(nothing(x) & nothing(y), "both_unclassified").when(nothing(x), "assigned_unclassified").when(nothing(y), "rederived_unclassified").when(x == y, "agree").otherwise("disagree")
    return rows.withColumn("agreement", kind)


def rescue(alignments: DataFrame, margin: int = 20, share: float = 0.01) -> DataFrame:
    """Per read, the reference of the longest alignment when it beats the primary's by `margin` bases and `share` of itself."""
    best = alignments.groupBy("read_id", "chromosome").agg(F.max("length").alias("length"), F.max("is_primary").alias("is_primary"))
    per = best.groupBy("read_id").agg(F.max_by("chromosome", F.struct("length", "chromosome")).alias("best"), F.max("length").alias("best_length"), F.max(F.when(F.col("is_primary"), F.col("length"))).alias("primary_length"), F.max(F.when(F.col("is_primary"), F.col("chromosome"))).alias("primary"))
    gain = F.col("best_length") - F.coalesce("primary_length", F.lit(0))
    return per.select("read_id", "primary", "best", gain.alias("gain"), ((F.col("best") != F.coalesce("primary", F.lit(""))) & (gain >= margin) & (gain >= share * F.col("best_length"))).alias("promote"))


def youden(scores: DataFrame, group: tuple[str, ...], score: str, positive: str) -> DataFrame:
    """Per group the threshold of greatest TPR - FPR (the first in descending scores), its J, and the counts."""
    per = scores.groupBy(*group, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    w = Window.partitionBy(*group)
    run = w.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    steps = per.select(*group, score, F.sum("p").over(run).alias("tp"), F.sum("n").over(run).alias("fp"), F.sum("p").over(w).alias("pos"), F.sum("n").over(w).alias("neg"))
    j = ratio(F.col("tp"), F.col("pos")) - ratio(F.col("fp"), F.col("neg"))
    return steps.where("pos > 0 and neg > 0").withColumn("j", F.round(j, 12)).groupBy(*group).agg(F.max_by(score, F.struct("j", score)).alias("threshold"), F.max("j").alias("j"), F.max("pos").alias("positives"), F.max("neg").alias("negatives"))
