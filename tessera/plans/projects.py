"""Registered experiments of a project, and declarative plans of model training."""

from __future__ import annotations

import hashlib
import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "seq long, experiment string, action string, lineage string, stage string, path string"


def experiments(log: DataFrame, *, active_only: bool = True, lineage: str | None = None) -> DataFrame:
    """The log of registrations folded: a row for each experiment and stage of one lineage, with its newest path.

    The lineage is the stated one, else the last activated, else the first added.  An experiment is inactive if
    it was removed after it was last added.  Nothing is forgotten: stages added at different times stand together.
    """
    when = lambda c, a, by=F.max_by: by(F.when(F.col("action").isin(*a), F.col(c)), F.when(F.col("action").isin(*a), F.col("seq")))
    state = log.groupBy("experiment").agg(when("action", ("add", "remove")).alias("_last"), F.coalesce(when("lineage", ("activate",)), when("lineage", ("add",), F.min_by)).alias("_own"))
    state = state.where("_last = 'add'") if active_only else state
    state = state.withColumn("_lineage", F.lit(lineage) if lineage is not None else F.col("_own"))
    spines = log.where("action = 'add'").groupBy("experiment", "lineage", "stage").agg(F.max_by("path", "seq").alias("path"))
    return spines.join(state.select("experiment", F.col("_lineage").alias("lineage")), ["experiment", "lineage"])


class Projects:
    """The log of registrations as a table in a shared folder; a change is one appended row, so writers do not meet."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _append(self, *rows: tuple) -> None:
        now = time.time_ns()
        self.spark.createDataFrame([(now + i, *r) for i, r in enumerate(rows)], LOG).coalesce(1).write.mode("append").parquet(self.path)

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.path)

    def add(self, experiment: str, stages: dict[str, str], lineage: str = "original") -> None:
        if not stages:
            raise ValueError("an experiment is added with a stage at least")
        self._append(*((experiment, "add", lineage, s, p) for s, p in stages.items()))

    def remove(self, experiment: str) -> None:
        self._append((experiment, "remove", None, None, None))

    def activate(self, experiment: str, lineage: str) -> None:
        if self.log().where((F.col("experiment") == experiment) & (F.col("lineage") == lineage) & (F.col("action") == "add")).isEmpty():
            raise ValueError(f"{experiment} has no lineage {lineage}")
        self._append((experiment, "activate", lineage, None, None))

    def list(self, *, active_only: bool = True, lineage: str | None = None) -> DataFrame:
        """Registered experiments; a stated lineage that one of them lacks is an error."""
        found = experiments(self.log(), active_only=active_only, lineage=lineage)
        if lineage is not None:
            lacking = experiments(self.log(), active_only=active_only).join(found, "experiment", "left_anti").select("experiment").distinct().limit(5).collect()
            if lacking:
                raise ValueError(f"no lineage {lineage}: {', '.join(r[0] for r in lacking)}")
        return found


#: Sections of a plan: the fields of each entry, those it must have, and the section that a field's value names an entry of.
SECTIONS = {
    "datasets": ({"set", "experiments", "features", "label", "group"}, {"features", "label"}, {}),
    "splits": ({"dataset", "kind", "shares", "roles", "seed"}, {"dataset", "kind"}, {"dataset": "datasets"}),
    "balancing": ({"method", "prevalence", "seed"}, {"method"}, {}),
    "models": ({"family", "settings", "seed"}, {"family"}, {}),
    "jobs": ({"split", "model", "balancing"}, {"split", "model"}, {"split": "splits", "model": "models", "balancing": "balancing"}),
}
KINDS = {"splits": ("kind", {"hash", "explicit", "stratified_group", "leave_one_group_out"}), "balancing": ("method", {"none", "weights", "downsample", "upsample", "prevalence"})}


def merged(base: Any, over: Any) -> Any:
    """Mappings are merged key by key; anything else is replaced."""
    if not (isinstance(base, dict) and isinstance(over, dict)):
        return over
    return base | {k: merged(base[k], v) if k in base else v for k, v in over.items()}


def training_plan(raw: dict, overrides: dict | None = None) -> tuple[dict, str]:
    """A checked plan and the digest of its canonical JSON; what is wrong is named by its place."""
    plan = merged(raw, overrides or {})
    if wrong := set(plan) - set(SECTIONS):
        raise ValueError(f"unknown sections: {sorted(wrong)}")
    plan = {s: plan.get(s, {}) for s in SECTIONS}
    for section, (fields, needed, names) in SECTIONS.items():
        for name, entry in plan[section].items():
            at = f"{section}.{name}"
            if wrong := set(entry) - fields:
                raise ValueError(f"{at}: unknown fields {sorted(wrong)}")
            if wrong := needed - set(entry):
                raise ValueError(f"{at}: fields missing {sorted(wrong)}")
            for field, other in names.items():
                if field in entry and entry[field] not in plan[other]:
                    raise ValueError(f"{at}.{field}: no entry {entry[field]!r} in {other}")
            field, known = KINDS.get(section, (None, ()))
            if field and entry[field] not in known:
                raise ValueError(f"{at}.{field}: {entry[field]!r} is none of {sorted(known)}")
            shares = entry.get("shares")
            if shares is not None and (min(shares.values()) < 0 or abs(sum(shares.values()) - 1) > 1e-9):
                raise ValueError(f"{at}.shares: not a share each, 1 in all")
            if section == "datasets" and ("set" in entry) == ("experiments" in entry):
                raise ValueError(f"{at}: a set or a list of experiments")
    text = json.dumps(plan, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return plan, hashlib.sha256(text.encode()).hexdigest()
