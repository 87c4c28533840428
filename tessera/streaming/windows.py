"""Structured Streaming forms of the windowed operators, each also usable on a batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stream of the Parquet files that match path (a folder, or one file's name in its folder)."""
    schema = schema or spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def watermarked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """events with a watermark, for which the time must carry a zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events


def tumbling(events: DataFrame, width: str, by: tuple[str, ...] = (), time: str = "ts", late: str | None = None) -> DataFrame:
    rows = watermarked(events, time, late)
    made = rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sliding(events: DataFrame, width: str, step: str, by: tuple[str, ...] = (), time: str = "ts", late: str | None = None) -> DataFrame:
    rows = watermarked(events, time, late)
    made = rows.groupBy(F.window(time, width, step).alias("w"), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return made.select(F.col("w.start").alias("window_start"), *by, "n", "mean")


def sessions(events: DataFrame, gap: str, by: tuple[str, ...], time: str = "ts", late: str | None = None) -> DataFrame:
    rows = watermarked(events, time, late)
    made = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return made.select(*by, F.col("w.start").alias("session_start"), "n", "peak")


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return watermarked(events, time, late).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: rows and totals so far, kept in state and given out after each batch that touches the key."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in parts:
            n, total = n + len(pdf), total + float(pdf[value].sum())
        state.update((n, total))
        yield pd.DataFrame([(group[0], n, total)], columns=[key, "n", "total"])

    kind = dict(events.dtypes)[key]
    return events.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into a Parquet table (append) or by the last batch's full result (complete); then read it."""
    spark, run = stream.sparkSession, uuid.uuid4().hex
    out, state = f"{folder}/{run}/out", f"{folder}/{run}/state"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = stream.schema
    if mode == "append":
        return spark.read.schema(schema).parquet(out)
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("epoch")).collect()[0][0]
    return rows.where(F.col("epoch") == last).drop("epoch") if mode == "complete" else rows
