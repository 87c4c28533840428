"""The machine-learning data plane: splits, balance, transforms, evaluation."""

from __future__ import annotations

import uuid
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import order
from tessera.operators.order import global_rank
from tessera.operators.qc import ratio
from tessera.sources.shared import shared_dir

ROLES = ("train", "validation", "test")


def hash_share(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) by arithmetic that any engine shares."""
    return ((key * 7919 + seed * 104729) % 1000003) / 1000003


def hash_split(rows: DataFrame, key: str, train: float = 0.7, validation: float = 0.15, seed: int = 42) -> DataFrame:
    u = hash_share(F.col(key), seed)
    return rows.withColumn("role", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def group_roles(counts: list[tuple[Any, Any, int]], shares: dict[str, float], attempts: int = 32, seed: int = 42) -> dict[Any, str]:
    """Roles of whole groups from (group, class, rows): greedy, largest first, over seeded orders; the best has the fewest missing classes, then the least squared error of row and class shares."""
    groups: dict[Any, dict[Any, int]] = {}
    for g, c, n in counts:
        groups.setdefault(g, {})[c] = n
    classes = sorted({c for v in groups.values() for c in v}, key=str)
    total = {c: sum(v.get(c, 0) for v in groups.values()) for c in classes}
    everything = sum(total.values())
    names = [r for r in shares if shares[r] > 0]

    def score(roles: dict[Any, str]) -> tuple[int, float]:
        held = {r: {c: 0 for c in classes} for r in names}
        for g, r in roles.items():
            for c, n in groups[g].items():
                held[r][c] += n
        missing = sum(held[r][c] == 0 for r in names for c in classes)
        error = sum((sum(held[r].values()) / max(1, everything) - shares[r]) ** 2 + sum((held[r][c] / max(1, total[c]) - shares[r]) ** 2 for c in classes) for r in names)
        return missing, error

    best: tuple[tuple[int, float], dict[Any, str]] | None = None
    for attempt in range(attempts):
        rng = np.random.default_rng((seed, attempt))
        order = sorted(groups, key=str)
        jitter = dict(zip(order, rng.random(len(order)) * (0.5 if attempt else 0.0), strict=True))
        order.sort(key=lambda g: -sum(groups[g].values()) * (1 + jitter[g]))
        held = {r: {c: 0 for c in classes} for r in names}
        roles: dict[Any, str] = {}
        for g in order:
            need = {r: sum((shares[r] * total[c] - held[r][c]) / max(1, total[c]) * groups[g].get(c, 0) for c in classes) for r in names}
            roles[g] = max(names, key=lambda r: (need[r], -names.index(r)))
            for c, n in groups[g].items():
                held[roles[g]][c] += n
        made = (score(roles), roles)
        if best is None or made[0] < best[0]:
            best = made
    return best[1] if best else {}


def stratified_group_split(rows: DataFrame, group: str, label: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Group-disjoint roles: the counts of groups and classes go to the driver, roles come back by a join."""
    counts = [(r[group], r[label], r["n"]) for r in rows.groupBy(group, label).agg(F.count("*").alias("n")).collect()]
    roles = group_roles(counts, shares, seed=seed)
    table = rows.sparkSession.createDataFrame(list(roles.items()), f"{group} {dict(rows.dtypes)[group]}, role string")
    return rows.join(table, group)


def leave_one_group_out(rows: DataFrame, group: str) -> DataFrame:
    """Every row once for each fold: test in its own group's fold, train elsewhere."""
    folds = rows.select(F.col(group).alias("fold")).distinct()
    return rows.crossJoin(F.broadcast(folds)).withColumn("role", F.when(F.col(group) == F.col("fold"), "test").otherwise("train"))


def leaking_groups(rows: DataFrame, group: str) -> DataFrame:
    """Groups found in more than one role: empty for a sound split."""
    return rows.groupBy(group).agg(F.count_distinct("role").alias("roles")).where("roles > 1")


def support(rows: DataFrame, *dims: str) -> DataFrame:
    """Counts of every combination of the dimensions' values, zeros too."""
    frame = None
    for d in dims:
        values = F.broadcast(rows.select(d).distinct())
        frame = values if frame is None else frame.crossJoin(values)
    return frame.join(rows.groupBy(*dims).agg(F.count("*").alias("n")), list(dims), "left").fillna(0, ["n"])


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """N / (K n_c)"""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return n.select(label, "n", (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"))


def class_rank(rows: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """rows with `_k`, their places in hash order within their class: ranks over the whole table, less the rows of the classes before."""
    ranked = global_rank(rows.withColumn("_h", hash_share(F.col(key), seed)), label, "_h", key, out="_r")
    ahead = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(label).agg(F.count("*").alias("_a")).select(label, F.coalesce(F.sum("_a").over(ahead), F.lit(0)).alias("_a"))
    return ranked.join(firsts, label).withColumn("_k", F.col("_r") - F.col("_a")).drop("_h", "_r", "_a")


def resampled(rows: DataFrame, label: str, key: str, method: str, seed: int = 42) -> DataFrame:
    """Downsampling to the smallest class by hash order, or upsampling to the largest by whole copies and a remainder."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    limit = sizes.agg((F.min if method == "down" else F.max)("_n").alias("_t"))
    marked = class_rank(rows, label, key, seed).join(sizes, label).crossJoin(F.broadcast(limit))
    if method == "down":
        return marked.where("_k <= _t").drop("_n", "_t", "_k").withColumn("copy", F.lit(0))
    copies = F.floor(F.col("_t") / F.col("_n")) + (F.col("_k") <= F.col("_t") % F.col("_n")).cast("long")
    return marked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_n", "_t", "_k")


def to_prevalence(rows: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """Positives cut down to a share of the result, in hash order."""
    negatives = rows.where(F.col(label) == 0).agg(F.count("*").alias("_n"))
    marked = class_rank(rows, label, key).crossJoin(F.broadcast(negatives))
    return marked.where((F.col(label) == 0) | (F.col("_k") <= F.floor(F.col("_n") * share / (1 - share) + 0.5 + 1e-9))).drop("_k", "_n")


def confusion(rows: DataFrame, y: str, score: str, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates at a threshold."""
    p = F.col(score) >= threshold
    pos = F.col(y) == 1
    n = lambda c: F.sum(c.cast("long"))
    made = rows.groupBy(*by).agg(n(p & pos).alias("tp"), n(p & ~pos).alias("fp"), n(~p & pos).alias("fn"), n(~p & ~pos).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, spec, precision = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    return made.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn)).withColumn("balanced_accuracy", (recall + spec) / 2).withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def curve(rows: DataFrame, y: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative counts at each distinct score, highest first: points of the ROC and precision-recall curves."""
    per = rows.groupBy(*by, score).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum((1 - F.col(y)).cast("long")).alias("n"))
    run = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    made = per.select(*by, score, "p", "n", F.sum("p").over(run).alias("tp"), F.sum("n").over(run).alias("fp"), F.sum("p").over(whole).alias("positives"), F.sum("n").over(whole).alias("negatives"))
    return made.withColumn("tpr", ratio(F.col("tp"), F.col("positives"))).withColumn("fpr", ratio(F.col("fp"), F.col("negatives"))).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def ranking_metrics(rows: DataFrame, y: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """ROC-AUC (trapezoids, so ties count half), average precision and prevalence."""
    c = curve(rows, y, score, by)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0))
    ap = F.sum(F.col("p") * F.col("precision"))
    made = c.groupBy(*by).agg(area.alias("_a"), ap.alias("_p"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives"))
    return made.select(*by, "positives", "negatives", ratio(F.col("_a"), F.col("positives") * F.col("negatives")).alias("roc_auc"), ratio(F.col("_p"), F.col("positives")).alias("average_precision"), ratio(F.col("positives"), F.col("positives") + F.col("negatives")).alias("prevalence"))


def best_threshold(rows: DataFrame, y: str, score: str, method: str = "f1", by: tuple[str, ...] = ()) -> DataFrame:
    """The threshold of greatest F1 or Youden J (ties to the higher threshold)."""
    c = curve(rows, y, score, by)
    value = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")) if method == "f1" else F.col("tpr") - F.col("fpr")
    return c.withColumn("_v", F.round(value, 12)).groupBy(*by).agg(F.max_by(score, F.struct("_v", score)).alias("threshold"), F.max("_v").alias("value"))


def log_scores(rows: DataFrame, y: str, score: str, by: tuple[str, ...] = (), eps: float = 1e-15) -> DataFrame:
    """Log loss and Brier score."""
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col(y) * F.ln(p) + (1 - F.col(y)) * F.ln(1 - p))
    return rows.groupBy(*by).agg(F.avg(loss).alias("log_loss"), F.avg(F.pow(F.col(score) - F.col(y), F.lit(2.0))).alias("brier"), F.count("*").alias("n"))


def calibration(rows: DataFrame, y: str, score: str, key: str, bins: int = 10) -> DataFrame:
    """Mean score and observed share of positives in equal-count bins of the score."""
    ranked = order.global_rank(rows.select(key, score, y), score, key)
    total = F.broadcast(rows.agg(F.count("*").alias("_total")))
    binned = ranked.crossJoin(total).withColumn("bin", order.tile(F.col("rank"), F.col("_total"), bins).cast("int"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("observed"))


def fold_summary(rows: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean and sample deviation across folds; a single fold has no deviation."""
    return rows.groupBy(metric).agg(F.count(value).alias("folds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


class Transform:
    """Imputation and scaling by column, fitted on one role and applied to all."""

    def __init__(self, columns: list[str], strategy: str = "mean", fill: float = 0.0, scale: bool = True) -> None:
        self.columns, self.strategy, self.fill, self.scale = columns, strategy, fill, scale
        self.fills: dict[str, float] = {}
        self.moments: dict[str, tuple[float, float]] = {}

    def fit(self, rows: DataFrame) -> Transform:
        """All columns in one pass; the most frequent value takes one more a column (ties to the smallest)."""
        if self.strategy in ("mean", "median"):
            how = F.avg if self.strategy == "mean" else lambda c: F.percentile(c, F.lit(0.5))
            got = rows.agg(*[how(F.col(c).cast("double")).alias(c) for c in self.columns]).collect()[0]
            self.fills = {c: self.fill if got[c] is None else float(got[c]) for c in self.columns}
        elif self.strategy == "most_frequent":
            for c in self.columns:
                top = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("n")).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v")).collect()[0]["v"]
                self.fills[c] = self.fill if top is None else float(top)
        else:
            self.fills = dict.fromkeys(self.columns, self.fill)
        filled = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c])).alias(c) for c in self.columns])
        got = filled.agg(*[x for c in self.columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]).collect()[0]
        self.moments = {c: (float(got[f"{c}_m"] or 0.0), float(got[f"{c}_s"] or 0.0) or 1.0) for c in self.columns}
        return self

    def apply(self, rows: DataFrame) -> DataFrame:
        made = {}
        for c in self.columns:
            x = F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c]))
            m, s = self.moments[c]
            made[f"{c}_missing"] = F.col(c).isNull()
            made[c] = (x - m) / s if self.scale else x
        return rows.withColumns(made)


def naive_bayes(rows: DataFrame, label: str, features: list[str], alpha: float = 1.0) -> DataFrame:
    """Bernoulli naive Bayes as a table of one row a class: log prior and the two log shares of each feature."""
    per = rows.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(F.col(f).cast("long")).alias(f"s_{f}") for f in features])
    total = F.sum("n").over(Window.partitionBy())
    on = lambda f: (F.col(f"s_{f}") + alpha) / (F.col("n") + 2 * alpha)
    return per.select(label, F.ln(F.col("n") / total).alias("prior"), *[x for f in features for x in (F.ln(on(f)).alias(f"on_{f}"), F.ln(1 - on(f)).alias(f"off_{f}"))])


def naive_bayes_scores(rows: DataFrame, model: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """Joint log-likelihood of each row and class: the log-odds contributions are its terms."""
    total = F.col("prior")
    for f in features:
        total = total + F.when(F.col(f) == 1, F.col(f"on_{f}")).otherwise(F.col(f"off_{f}"))
    return rows.select(key, *features).crossJoin(F.broadcast(model)).select(key, label, total.alias("log_joint"))


def fit_model(rows: DataFrame, vector: str, label: str, family: str, seed: int = 42, layers: tuple[int, ...] = (16,), rounds: int = 60):
    """A model of an array column, fitted on all rows by Spark's distributed trainers: logistic, forest or perceptron (layers between input and output)."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    train = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    if family == "logistic":
        made = LogisticRegression(maxIter=rounds, regParam=0.01)
    elif family == "forest":
        made = RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed)
    elif family == "perceptron":
        width = train.select("features").head()["features"].size
        made = MultilayerPerceptronClassifier(layers=[width, *layers, 2], maxIter=rounds, seed=seed)
    else:
        raise ValueError(f"unknown family {family}")
    # The stored model, without the trainer's summary, which would hang the training table on every task.
    model = made.fit(train)
    path = f"{shared_dir(rows.sparkSession)}/tessera/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).load(path)


def predict(model, rows: DataFrame, vector: str, out: str = "score") -> DataFrame:
    """rows with the model's probability of class 1."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    made = model.transform(rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    return made.withColumn(out, vector_to_array("probability")[1]).select(*rows.columns, out)
