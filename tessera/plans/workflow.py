"""Running analyses: batches over many configurations, workflows with a result contract, and selective reprocessing plans."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalog import Planner
from tessera.sources import tables as io

BATCH = "name string, status string, rows long, error string"


def run_batch(spark: SparkSession, names: Iterable[str], task: Callable[[str], DataFrame]) -> DataFrame:
    """A stage over many configurations: a failed one is recorded with its error, and the others still run."""
    out = []
    for name in names:
        try:
            out.append((name, "ok", task(name).count(), None))
        except Exception as e:  # noqa: BLE001
            out.append((name, "failed", None, f"{type(e).__name__}: {e}".splitlines()[0][:200]))
    return spark.createDataFrame(out, BATCH)


@dataclass
class Workflow:
    """Analyses that write tables under a folder, and the result that says what was run, from what, and where it is."""

    spark: SparkSession
    root: str
    planner: Planner = field(default_factory=Planner)
    made: dict[str, Callable[[Workflow], DataFrame]] = field(default_factory=dict)

    def add(self, node, make: Callable[[Workflow], DataFrame]) -> None:
        self.planner.register(node)
        self.made[node.name] = make

    def table(self, name: str) -> DataFrame:
        return io.read_current(self.spark, f"{self.root}/{name}")

    def result(self) -> dict:
        """The last result, or an empty one."""
        try:
            rows = self.spark.read.text(f"{self.root}/result").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return {"nodes": {}}
            raise
        return json.loads(rows[0]["value"])

    def run(self, targets: list[str]) -> dict[str, str]:
        """Make what is not compatible with the recorded results, in order; the states before the run.  The result is written after each table, so a run that ends early is taken up where it stood."""
        done = self.result()
        states = self.planner.plan(targets, {k: v["record"] for k, v in done["nodes"].items()})
        for name, state in states.items():
            if state == "blocked_missing_input":
                raise RuntimeError(f"{name} lacks an input")
            if state != "compatible":
                generation = io.write_versioned(self.made[name](self), f"{self.root}/{name}")
                done["nodes"][name] = {"record": self.planner.record(name), "generation": generation, "rows": self.table(name).count()}
                self.spark.createDataFrame([(json.dumps(done, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/result")
        return states

    def validate(self) -> list[str]:
        """What is wrong with the result: tables that can't be read, other row counts, or records that the plan no longer makes."""
        wrong = []
        for name, entry in self.result()["nodes"].items():
            if name not in self.planner.nodes or self.planner.record(name) != entry["record"]:
                wrong.append(f"{name}: not what the plan makes")
            try:
                rows = self.spark.read.parquet(f"{self.root}/{name}/generation={entry['generation']}").count()
            except AnalysisException:
                wrong.append(f"{name}: table is gone")
                continue
            if rows != entry["rows"]:
                wrong.append(f"{name}: {rows} rows in place of {entry['rows']}")
        return wrong


def rebasecall_plan(selected: DataFrame, sources: DataFrame, key: str = "read_id", source: str = "source") -> DataFrame:
    """Each selected read with the one source that holds its signal: ready, missing_source or ambiguous_source."""
    held = sources.groupBy(key).agg(F.count_distinct(source).alias("_n"), F.min(source).alias("_s"))
    n = F.coalesce("_n", F.lit(0))
    status = F.when(n == 0, "missing_source").when(n > 1, "ambiguous_source").otherwise("ready")
    return selected.select(key).distinct().join(held, key, "left").select(key, status.alias("status"), F.when(n == 1, F.col("_s")).alias(source))


def plan_id(plan: DataFrame, key: str = "read_id", source: str = "source") -> str:
    """A digest of a plan's rows whatever their order: sums of their hashes, and their number."""
    h = F.xxhash64(F.col(key).cast("string"), "status", F.col(source).cast("string"))
    r = plan.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).collect()[0]
    return f"{r['n']}-{r['s']}-{r['x']}"


def freeze(plan: DataFrame, root: str, accepted: str) -> str:
    """The ready reads as a new generation, if the plan still is the accepted one and nothing blocks it."""
    if plan_id(plan) != accepted:
        raise ValueError("the plan is not the one that was accepted")
    if plan.where("status <> 'ready'").take(1):
        raise ValueError("some reads have no source, or several")
    return io.write_versioned(plan, root)
