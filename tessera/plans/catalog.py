"""The project catalog: experiments, references, saved sets, SQL over them, generations, and planning of analyses."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Catalog:
    """Named tables of a project, visible to SQL, and saved selections of experiments."""

    def __init__(self, spark: SparkSession, **tables: DataFrame) -> None:
        self.spark, self.tables, self.sets = spark, dict(tables), {}

    def query(self, sql: str) -> DataFrame:
        """SQL in which {name} is a table of the catalog."""
        return self.spark.sql(sql, **{n: t for n, t in self.tables.items() if "{" + n + "}" in sql})

    def add_set(self, name: str, experiments: list | None = None, predicate: str | None = None) -> None:
        if (experiments is None) == (predicate is None):
            raise ValueError("a set is a list or a predicate")
        if predicate is not None:
            self.tables["experiments"].where(predicate).schema  # noqa: B018  a wrong predicate fails here
        self.sets[name] = predicate if predicate is not None else list(experiments)

    def resolve(self, name: str) -> DataFrame:
        rule, rows = self.sets[name], self.tables["experiments"]
        return rows.where(rule) if isinstance(rule, str) else rows.where(F.col("experiment").isin(rule))

    def select(self, *, canonical: str | None = None, modality: str | None = None, set_name: str | None = None) -> DataFrame:
        rows = self.tables["refs"]
        if canonical is not None:
            rows = rows.where(F.col("canonical_reference") == canonical)
        if modality is not None:
            rows = rows.where(F.col("modality") == modality)
        return rows.join(self.resolve(set_name).select("experiment"), "experiment", "left_semi") if set_name else rows


def canonical_names(references: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """uid with its registered name, else its first alias, else itself."""
    first = aliases.groupBy("uid").agg(F.min("alias").alias("alias"))
    return references.join(names, "uid", "left").join(first, "uid", "left").withColumn("canonical_reference", F.coalesce("name", "alias", F.col("uid").cast("string")))


def prune_plan(generations: DataFrame, keep_last: int, older_than: str | None = None) -> DataFrame:
    """Generations with `prune`: not pinned, not current, past the newest keep_last of their stage, and old enough."""
    k = F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("created"), F.desc("generation")))
    old = F.col("created") < F.expr(f"timestamp_ntz '{older_than}'") if older_than else F.lit(True)
    return generations.withColumn("age", k).withColumn("prune", (F.col("age") > keep_last) & ~F.col("pinned") & old)


def one_lineage(experiments: DataFrame) -> DataFrame:
    """Experiments with more than one active lineage: empty for a sound project."""
    return experiments.where("status = 'active'").groupBy("experiment").agg(F.count("*").alias("lineages")).where("lineages > 1")


@dataclass(frozen=True)
class Node:
    """An analysis: what it needs, its algorithm's version, and its settings."""

    name: str
    needs: tuple[str, ...] = ()
    version: str = "1"
    settings: tuple[tuple[str, str], ...] = ()

    def fingerprint(self, inputs: dict[str, str]) -> str:
        body = [self.name, self.version, sorted(self.settings), sorted((k, inputs[k]) for k in self.needs)]
        return hashlib.sha256(json.dumps(body).encode()).hexdigest()


@dataclass
class Planner:
    """Which analyses must run: decided in topological order from recorded results."""

    nodes: dict[str, Node] = field(default_factory=dict)
    runners: dict[str, Callable] = field(default_factory=dict)

    def register(self, node: Node, runner: Callable | None = None) -> None:
        self.nodes[node.name] = node
        if runner:
            self.runners[node.name] = runner

    def order(self, targets: list[str]) -> list[str]:
        out: list[str] = []
        open_: set[str] = set()

        def visit(name: str) -> None:
            if name in out:
                return
            if name in open_:
                raise ValueError(f"cycle at {name}")
            if name not in self.nodes:
                raise KeyError(name)
            open_.add(name)
            for n in self.nodes[name].needs:
                visit(n)
            open_.discard(name)
            out.append(name)

        for t in targets:
            visit(t)
        return out

    def plan(self, targets: list[str], recorded: dict[str, dict[str, str]], missing_inputs: set[str] = frozenset()) -> dict[str, str]:
        """State of each node: compatible, missing, stale_config, stale_algorithm, stale_input, dependent_recompute or blocked_missing_input."""
        prints: dict[str, str] = {}
        states: dict[str, str] = {}
        for name in self.order(targets):
            node = self.nodes[name]
            prints[name] = node.fingerprint(prints)
            was = recorded.get(name)
            if name in missing_inputs or any(states[n] == "blocked_missing_input" for n in node.needs):
                states[name] = "blocked_missing_input"
            elif was is None:
                states[name] = "missing"
            elif was.get("version") != node.version:
                states[name] = "stale_algorithm"
            elif was.get("settings") != json.dumps(sorted(node.settings)):
                states[name] = "stale_config"
            elif any(states[n] != "compatible" for n in node.needs):
                states[name] = "dependent_recompute"
            elif was.get("fingerprint") != prints[name]:
                states[name] = "stale_input"
            else:
                states[name] = "compatible"
        return states

    def record(self, name: str) -> dict[str, str]:
        prints: dict[str, str] = {}
        for n in self.order([name]):
            prints[n] = self.nodes[n].fingerprint(prints)
        node = self.nodes[name]
        return {"version": node.version, "settings": json.dumps(sorted(node.settings)), "fingerprint": prints[name]}

    def execute(self, targets: list[str], recorded: dict[str, dict[str, str]]) -> list[str]:
        """Run what is not compatible, in order; results are recorded as they finish."""
        done = []
        for name, state in self.plan(targets, recorded).items():
            if state == "blocked_missing_input":
                raise RuntimeError(f"{name} lacks an input")
            if state != "compatible":
                if name in self.runners:
                    self.runners[name]()
                recorded[name] = self.record(name)
                done.append(name)
        return done


def estimate_bytes(reads: int, width: int, layers: int) -> int:
    """Bytes of a dense selection: 8-byte cells, twice for the copy."""
    return reads * width * layers * 8 * 2


def batch_rows(positions: int, arrays: int = 1, memory_mb: int = 512) -> int:
    """Rows of an Arrow batch for a projection's width: 4 bytes a cell, twice for the copy; for spark.sql.execution.arrow.maxRecordsPerBatch."""
    if memory_mb <= 0:
        raise ValueError("memory must be positive")
    return max(1, memory_mb * (1 << 20) // (max(1, positions) * max(1, arrays) * 8))


def refuse_over(size: int, most: int) -> None:
    if size > most:
        raise MemoryError(f"the selection needs {size} bytes, over the limit of {most}")
