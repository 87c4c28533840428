"""Session defaults shared by tests, the bench and applications."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int = 8, batch_rows: int = 10_000, **extra: str) -> SparkSession:
    """A local session; batch_rows (see plans.catalog.batch_rows) bounds the Arrow batches of Python workers; on a cluster the master and the sizes come from spark-submit."""
    conf = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | extra
    return SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
