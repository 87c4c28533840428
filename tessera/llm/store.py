"""Where stages cut their lineage: Parquet tables in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's folder; only where it names none and the master is this machine (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: later reads need none of the work, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_buckets(spark: SparkSession, each: int = 4) -> int:
    """Buckets for blob shuffles: several for each shuffle partition, so that a bucket's size falls as partitions are added."""
    return each * max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
