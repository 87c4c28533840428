"""Readers and writers: text formats of the field, the partitioned store, exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cigar as C
from tessera.operators.order import global_rank

BED = "reference string, start long, stop long, name string, score string, strand string"


def read_bed(spark: SparkSession, path: str, scope: str, lengths: DataFrame | None = None) -> DataFrame:
    """BED3 to BED6 rows; comment lines are skipped; with reference lengths, intervals are clipped and ones on unknown references or turned empty are dropped."""
    rows = spark.read.csv(path, sep="\t", schema=BED, comment="#", mode="PERMISSIVE").where("reference is not null and not (reference like 'track%' or reference like 'browser%')")
    if lengths is not None:
        rows = rows.join(F.broadcast(lengths.select("reference", F.col("length").alias("_n"))), "reference")
        rows = rows.withColumn("start", F.greatest("start", F.lit(0).cast("long"))).withColumn("stop", F.least("stop", "_n")).drop("_n")
    ident = F.concat_ws(":", F.lit(scope), "reference", F.concat_ws("-", F.col("start").cast("string"), F.col("stop").cast("string")))
    return rows.where("start < stop").select(F.lit(scope).alias("scope"), "reference", "start", "stop", F.coalesce("name", ident).alias("name"), F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".").alias("strand"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """reference, sequence: a row for each record; the record mark splits the file, so records are read in parallel."""
    raw = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    return raw.select(F.split(lines[0], r"\s+")[0].alias("reference"), F.upper(F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), F.trim), "")).alias("sequence"))


def read_calls_tsv(spark: SparkSession, path: str, references: list[str] | None = None, reads: DataFrame | None = None) -> DataFrame:
    """Modification calls from tab-separated files with a header: filtered by reference and read, code to probability."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="read_id string, chrom string, ref_position long, call_code string, call_prob double")
    if references is not None:
        rows = rows.where(F.col("chrom").isin(references))
    if reads is not None:
        rows = rows.join(reads.select("read_id"), "read_id", "left_semi")
    p = F.when(F.col("call_code") == "-", 1 - F.col("call_prob")).otherwise(F.col("call_prob"))
    return rows.select("read_id", F.col("chrom").alias("reference"), F.col("ref_position").alias("position"), p.alias("signal"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments from text SAM files: placement (from 0, half-open), flags as columns, program, bases, qualities, and tags by name."""
    f = F.split(F.col("value"), "\t", -1)
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '@')").select(f.alias("f"))
    flag = F.col("f")[1].cast("int")
    on = lambda bit: flag.bitwiseAND(F.lit(bit)) != 0
    cigar = F.when(F.col("f")[5] != "*", F.col("f")[5])
    start = F.col("f")[3].cast("long") - 1
    tags = F.map_from_entries(F.transform(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v"))))
    mapped = ~on(4)
    return rows.select(
        F.col("f")[0].alias("read_id"), F.when(mapped, F.col("f")[2]).alias("reference"), F.when(mapped, start).alias("reference_start"), F.when(mapped, start + C.reference_length(cigar)).alias("reference_end"),
        F.when(on(16), "-").otherwise("+").alias("strand"), on(256).alias("is_secondary"), on(2048).alias("is_supplementary"), mapped.alias("is_mapped"), F.col("f")[4].cast("int").alias("mapping_quality"), cigar.alias("cigar"),
        F.when(F.col("f")[9] != "*", F.col("f")[9]).alias("sequence"), F.when(F.col("f")[10] != "*", F.col("f")[10]).alias("qualities"), tags.alias("tags"),
    )


def read_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Content-addressed inputs: path, bytes and digest of every file that matches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_id"))


def write_store(segments: DataFrame, path: str, aligned: Column, bin_size: int = 1_000_000, rows_per_file: int = 100_000) -> None:
    """Segments with their reference_end, by (reference, start bin), sorted inside, files bounded; the sort gives row groups tight bounds, and the zones say how far a bin's segments reach."""
    rows = segments.withColumn("start_bin", F.floor(F.col("reference_start") / bin_size)).withColumn("reference_end", F.col("reference_start") + aligned)
    rows = rows.repartition("reference", "start_bin", F.pmod(F.xxhash64("read_id"), F.lit(16))).sortWithinPartitions("reference", "start_bin", "reference_start", "read_id")
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("reference", "start_bin").parquet(f"{path}/segments")
    stored = segments.sparkSession.read.parquet(f"{path}/segments")
    zone_map(stored, bin_size, F.col("reference_end") - F.col("reference_start")).coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")


def read_store(spark: SparkSession, path: str, reference: str | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """Segments that overlap a window, however long they are; bins that do not reach it are pruned by the store's zones."""
    rows = spark.read.parquet(f"{path}/segments")
    if reference is not None:
        rows = rows.where(F.col("reference") == reference)
    if window is not None:
        lo, hi = window
        zones = spark.read.parquet(f"{path}/zones").where((F.col("min_start") < hi) & (F.col("max_end") > lo))
        zones = zones if reference is None else zones.where(F.col("reference") == reference)
        first, last = zones.agg(F.min("start_bin"), F.max("start_bin")).collect()[0]
        rows = rows.where(F.col("start_bin").between(first if first is not None else 0, last if last is not None else -1) & (F.col("reference_start") < hi) & (F.col("reference_end") > lo))
    return rows


def zone_map(segments: DataFrame, bin_size: int, aligned: Column) -> DataFrame:
    rows = segments.withColumn("start_bin", F.floor(F.col("reference_start") / bin_size)).withColumn("_l", aligned)
    return rows.groupBy("reference", "start_bin").agg(F.min("reference_start").alias("min_start"), F.max(F.col("reference_start") + F.col("_l")).alias("max_end"), F.count("*").alias("n_reads"), F.sum("_l").alias("aligned_bases"))


def write_fastq(records: DataFrame, path: str, group: str) -> None:
    """Text files of records, a folder for each group."""
    records.select(group, "record").write.mode("overwrite").partitionBy(group).text(path)


def write_versioned(df: DataFrame, root: str, partition: tuple[str, ...] = ()) -> str:
    """A new generation in its own folder; `current` then names it.  Readers of the old one are not disturbed, and a failed write is never current."""
    spark, generation = df.sparkSession, uuid.uuid4().hex
    w = df.write
    (w.partitionBy(*partition) if partition else w).parquet(f"{root}/generation={generation}")
    spark.createDataFrame([(json.dumps({"generation": generation}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/current")
    return generation


def read_current(spark: SparkSession, root: str) -> DataFrame:
    name = json.loads(spark.read.text(f"{root}/current").collect()[0]["value"])["generation"]
    return spark.read.parquet(f"{root}/generation={name}")


def wide(calls: DataFrame, positions: list[int], value: str = "call") -> DataFrame:
    """One column a position, for a bounded list of positions."""
    made = calls.where(F.col("position").isin(positions)).groupBy("read_id").pivot("position", positions).agg(F.first(value))
    return made.select("read_id", *[F.col(str(p)).alias(f"p{p}") for p in positions])


def row_ranges(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Contiguous row ranges of a column's values in an order."""
    n = global_rank(rows.select(key, order), order).select(key, (F.col("rank") - 1).alias("row"))
    return n.groupBy(key).agg(F.min("row").alias("start_row"), (F.max("row") + 1).alias("end_row"))


def write_bundle(root: str, parts: dict[str, DataFrame]) -> None:
    """Several tables of one export; the manifest (name, rows, columns) is written last, so a bundle without one is not finished."""
    found = []
    for name, df in sorted(parts.items()):
        df.write.parquet(f"{root}/{name}")
        found.append((name, df.sparkSession.read.parquet(f"{root}/{name}").count(), ",".join(df.columns)))
    next(iter(parts.values())).sparkSession.createDataFrame(found, "name string, rows long, columns string").coalesce(1).write.parquet(f"{root}/manifest")


def read_bundle(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {r["name"]: spark.read.parquet(f"{root}/{r['name']}") for r in spark.read.parquet(f"{root}/manifest").collect()}
