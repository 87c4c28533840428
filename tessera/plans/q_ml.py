"""Queries of the machine-learning data plane."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import ml
from tessera.plans.registry import Tables, query

SHARE = "((k * 7919 + 42 * 104729) % 1000003) / 1000003.0::DOUBLE"


@query(f"SELECT k AS read_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS role FROM (SELECT k, {SHARE} AS u FROM (SELECT o_orderkey AS k FROM orders))")
def ml_hash_split(t: Tables):
    return ml.hash_split(t.orders.select(F.col("o_orderkey").alias("read_id")), "read_id")


@query()
def ml_stratified_group_split(t: Tables):
    """Group-disjoint roles of orders by customer nation, stratified by status; tests check disjointness and shares."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "o_orderstatus")
    return ml.stratified_group_split(rows, "c_nationkey", "o_orderstatus", {"train": 0.7, "validation": 0.15, "test": 0.15})


@query("SELECT f.fold, CASE WHEN l.doc_id % 5 = f.fold THEN 'test' ELSE 'train' END AS role, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positives FROM labels l, (SELECT range AS fold FROM range(5)) f GROUP BY 1, 2")
def ml_leave_one_group_out(t: Tables):
    rows = t.labels.withColumn("g", F.col("doc_id") % 5)
    return ml.leave_one_group_out(rows, "g").groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("quality").alias("positives"))


@query(f"SELECT o_custkey AS g, count(DISTINCT role) AS roles FROM (SELECT o_custkey, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS role FROM (SELECT o_custkey, {SHARE} AS u FROM (SELECT o_custkey, o_orderkey AS k FROM orders))) GROUP BY 1 HAVING count(DISTINCT role) > 1")
def ml_leakage_check(t: Tables):
    rows = ml.hash_split(t.orders.select("o_orderkey", F.col("o_custkey").alias("g")), "o_orderkey")
    return ml.leaking_groups(rows, "g")


@query("SELECT a.fold, b.quality, c.toxic, coalesce(n, 0) AS n FROM (SELECT DISTINCT doc_id % 5 AS fold FROM labels) a, (SELECT DISTINCT quality FROM labels) b, (SELECT DISTINCT toxic FROM labels) c LEFT JOIN (SELECT doc_id % 5 AS fold, quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2, 3) x ON x.fold = a.fold AND x.quality = b.quality AND x.toxic = c.toxic")
def ml_class_support(t: Tables):
    return ml.support(t.labels.withColumn("fold", F.col("doc_id") % 5), "fold", "quality", "toxic")


@query("SELECT o_orderstatus AS label, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def ml_class_weights(t: Tables):
    return ml.class_weights(t.orders.withColumnRenamed("o_orderstatus", "label"), "label").withColumn("weight", F.round("weight", 9))


@query(f"SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY u, doc_id) AS r FROM (SELECT doc_id, quality, {SHARE.replace('k *', 'doc_id *')} AS u FROM labels)) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))")
def ml_downsample(t: Tables):
    return ml.resampled(t.labels, "quality", "doc_id", "down").select("doc_id", "quality")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY u, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM (SELECT doc_id, quality, {SHARE.replace('k *', 'doc_id *')} AS u FROM labels)), m AS (SELECT max(n) AS t FROM r)
SELECT doc_id, quality, CAST(c.range AS BIGINT) AS copy FROM r, m, range(200) c WHERE c.range < t // n + CASE WHEN r <= t % n THEN 1 ELSE 0 END""")
def ml_upsample(t: Tables):
    return ml.resampled(t.labels, "quality", "doc_id", "up").select("doc_id", "quality", "copy")


@query(f"SELECT doc_id, y FROM (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY u, doc_id) AS r FROM (SELECT doc_id, y, {SHARE.replace('k *', 'doc_id *')} AS u FROM $predictions)) WHERE y = 0 OR r <= floor((SELECT count(*) FROM $predictions WHERE y = 0) * CAST(0.2 AS DOUBLE) / 0.8 + 0.5 + 1e-9)")
def ml_rebalance_prevalence(t: Tables):
    return ml.to_prevalence(t.predictions, "y", "doc_id", 0.2).select("doc_id", "y")


CONF = "count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y = 0) AS tn"


@query(f"SELECT modality, tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 9) AS accuracy, round((tp / CAST(nullif(tp + fn, 0) AS DOUBLE) + tn / CAST(nullif(tn + fp, 0) AS DOUBLE)) / 2, 9) AS balanced_accuracy, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 9) AS \"precision\", round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 9) AS recall, round(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 9) AS f1 FROM (SELECT modality, {CONF} FROM $predictions GROUP BY 1)")
def ml_confusion(t: Tables):
    made = ml.confusion(t.predictions, "y", "score", 0.5, ("modality",))
    return made.select("modality", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")])


CURVE = """(SELECT fold, score, p, n, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER (PARTITION BY fold) AS BIGINT) AS positives, CAST(sum(n) OVER (PARTITION BY fold) AS BIGINT) AS negatives FROM (SELECT fold, score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM $predictions GROUP BY 1, 2) WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"SELECT fold, score, tp, fp, round(tp / CAST(positives AS DOUBLE), 9) AS tpr, round(fp / CAST(negatives AS DOUBLE), 9) AS fpr, round(tp / CAST(tp + fp AS DOUBLE), 9) AS \"precision\" FROM {CURVE}")
def ml_roc_curve(t: Tables):
    return ml.curve(t.predictions, "y", "score", ("fold",)).select("fold", "score", "tp", "fp", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "precision")])


@query(f"SELECT fold, max(positives) AS positives, max(negatives) AS negatives, round(sum(n * (tp - p / 2.0)) / (max(positives) * max(negatives)), 9) AS roc_auc, round(sum(p * (tp / CAST(tp + fp AS DOUBLE))) / max(positives), 9) AS average_precision, round(max(positives) / CAST(max(positives) + max(negatives) AS DOUBLE), 9) AS prevalence FROM {CURVE} GROUP BY 1")
def ml_ranking_metrics(t: Tables):
    made = ml.ranking_metrics(t.predictions, "y", "score", ("fold",))
    return made.select("fold", "positives", "negatives", *[F.round(c, 9).alias(c) for c in ("roc_auc", "average_precision", "prevalence")])


@query(f"SELECT fold, score AS threshold, round(v, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY v DESC, score DESC) AS r FROM (SELECT fold, score, round(2 * tp / CAST(tp + fp + positives AS DOUBLE), 12) AS v FROM {CURVE})) WHERE r = 1")
def ml_threshold_f1(t: Tables):
    return ml.best_threshold(t.predictions, "y", "score", "f1", ("fold",)).withColumn("value", F.round("value", 9))


@query(f"SELECT fold, score AS threshold, round(v, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY v DESC, score DESC) AS r FROM (SELECT fold, score, round(tp / CAST(positives AS DOUBLE) - fp / CAST(negatives AS DOUBLE), 12) AS v FROM {CURVE})) WHERE r = 1")
def ml_threshold_youden(t: Tables):
    return ml.best_threshold(t.predictions, "y", "score", "youden", ("fold",)).withColumn("value", F.round("value", 9))


@query("SELECT modality, round(avg(-(y * ln(greatest(least(score, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)))), 6) AS log_loss, round(avg(pow(score - y, 2)), 9) AS brier, count(*) AS n FROM $predictions GROUP BY 1")
def ml_log_loss_brier(t: Tables):
    made = ml.log_scores(t.predictions, "y", "score", ("modality",))
    return made.withColumn("log_loss", F.round("log_loss", 6)).withColumn("brier", F.round("brier", 9))


@query("SELECT bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(y), 9) AS observed FROM (SELECT *, CAST(ntile(10) OVER (ORDER BY score, doc_id) AS INT) AS bin FROM $predictions) GROUP BY 1")
def ml_calibration(t: Tables):
    made = ml.calibration(t.predictions, "y", "score", "doc_id")
    return made.withColumn("mean_score", F.round("mean_score", 9)).withColumn("observed", F.round("observed", 9))


@query("SELECT 'accuracy' AS metric, count(a) AS folds, round(avg(a), 9) AS mean, round(stddev_samp(a), 9) AS sd FROM (SELECT fold, avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS a FROM $predictions GROUP BY 1)")
def ml_fold_metrics(t: Tables):
    per = ml.confusion(t.predictions, "y", "score", 0.5, ("fold",)).select(F.lit("accuracy").alias("metric"), "accuracy")
    made = ml.fold_summary(per, "metric", "accuracy")
    return made.withColumn("mean", F.round("mean", 9)).withColumn("sd", F.round("sd", 9))


@query("SELECT DISTINCT sha256('salt' || chr(1) || CAST(doc_id AS VARCHAR)) AS identity, score, y FROM $predictions")
def ml_prediction_rows(t: Tables):
    uid = F.sha2(F.concat_ws("\x01", F.lit("salt"), F.col("doc_id").cast("string")).cast("binary"), 256)
    return t.predictions.select(uid.alias("identity"), "score", "y").distinct()


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS b FROM orders), f AS (SELECT avg(a) AS ma, avg(CAST(b AS DOUBLE)) AS mb FROM x WHERE o_orderkey % 2 = 0), y AS (SELECT o_orderkey, coalesce(a, ma) AS a, coalesce(CAST(b AS DOUBLE), mb) AS b, a IS NULL AS a_missing, b IS NULL AS b_missing FROM x, f), s AS (SELECT avg(a) AS xa, stddev_pop(a) AS sa, avg(b) AS xb, stddev_pop(b) AS sb FROM y WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, round((a - xa) / sa, 6) + 0.0 AS a, round((b - xb) / sb, 6) + 0.0 AS b, a_missing, b_missing FROM y, s""")
def ml_feature_transform(t: Tables):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("b"))
    made = ml.Transform(["a", "b"]).fit(rows.where("o_orderkey % 2 = 0")).apply(rows)
    return made.select("o_orderkey", (F.round("a", 6) + 0.0).alias("a"), (F.round("b", 6) + 0.0).alias("b"), "a_missing", "b_missing")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 > 0 THEN CAST(c_nationkey AS DOUBLE) END, (SELECT v FROM (SELECT c_nationkey AS v, count(*) AS n FROM customer WHERE c_custkey % 4 > 0 GROUP BY 1 ORDER BY n DESC, v LIMIT 1))) AS nation, coalesce(CASE WHEN c_custkey % 6 > 0 THEN c_acctbal END, (SELECT median(c_acctbal) FROM customer WHERE c_custkey % 6 > 0)) AS balance FROM customer")
def ml_impute_mode_median(t: Tables):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")).alias("nation"), F.when(F.col("c_custkey") % 6 > 0, F.col("c_acctbal")).alias("balance"))
    made = ml.Transform(["nation"], "most_frequent", scale=False).fit(rows).apply(rows)
    return ml.Transform(["balance"], "median", scale=False).fit(rows).apply(made).select("c_custkey", "nation", "balance")


NB = "(SELECT o_orderkey, o_orderstatus AS label, CAST(o_totalprice > 250000 AS INT) AS f1, CAST(o_custkey % 3 = 0 AS INT) AS f2 FROM orders)"


@query(f"""WITH m AS (SELECT label, ln(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)) AS prior, (sum(f1) + 1) / CAST(count(*) + 2 AS DOUBLE) AS p1, (sum(f2) + 1) / CAST(count(*) + 2 AS DOUBLE) AS p2 FROM {NB} GROUP BY 1)
SELECT x.o_orderkey, m.label, round(prior + CASE WHEN f1 = 1 THEN ln(p1) ELSE ln(1 - p1) END + CASE WHEN f2 = 1 THEN ln(p2) ELSE ln(1 - p2) END, 6) AS log_joint FROM {NB} x, m""")
def ml_naive_bayes(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("label"), (F.col("o_totalprice") > 250000).cast("int").alias("f1"), (F.col("o_custkey") % 3 == 0).cast("int").alias("f2"))
    model = ml.naive_bayes(rows, "label", ["f1", "f2"])
    return ml.naive_bayes_scores(rows, model, "o_orderkey", "label", ["f1", "f2"]).withColumn("log_joint", F.round("log_joint", 6))


@query("SELECT s.range * 10 AS window_start, fold, count(*) AS n, round(avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM $predictions JOIN range(9) s ON doc_id % 100 >= s.range * 10 AND doc_id % 100 < s.range * 10 + 20 GROUP BY 1, 2")
def ml_sliding_window_evaluation(t: Tables):
    from tessera.operators import islands

    rows = islands.sliding(t.predictions.withColumn("at", F.col("doc_id") % 100), "at", 20, 10, 0, 100)
    right = ((F.col("score") >= 0.5) == (F.col("y") == 1)).cast("double")
    return rows.groupBy("window_start", "fold").agg(F.count("*").alias("n"), F.round(F.avg(right), 9).alias("accuracy"))


@query(f"SELECT doc_id FROM (SELECT doc_id FROM (SELECT doc_id, {SHARE.replace('k *', 'doc_id *')} AS u FROM labels WHERE doc_id % 5 <> 0) ORDER BY u, doc_id LIMIT 60)")
def ml_training_background(t: Tables):
    return t.labels.where("doc_id % 5 <> 0").orderBy(ml.hash_share(F.col("doc_id")), "doc_id").limit(60).select("doc_id").orderBy("doc_id")


@query("SELECT count(*) FILTER (score < 0 OR score > 1) AS out_of_range, count(*) FILTER (y NOT IN (0, 1)) AS bad_labels, count(*) - count(DISTINCT doc_id) AS repeated, CAST(sum(y) AS BIGINT) AS positives FROM $predictions")
def ml_contract_checks(t: Tables):
    n = lambda c: F.sum(c.cast("long"))
    return t.predictions.agg(n((F.col("score") < 0) | (F.col("score") > 1)).alias("out_of_range"), n(~F.col("y").isin(0, 1)).alias("bad_labels"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated"), F.sum("y").alias("positives"))


@query("SELECT c_mktsegment AS experiment, arg_max(c_custkey, c_acctbal * 100000 + c_custkey % 1000) AS model, max(c_acctbal) AS metric FROM customer GROUP BY 1")
def ml_best_model(t: Tables):
    return t.customer.groupBy(F.col("c_mktsegment").alias("experiment")).agg(F.max_by("c_custkey", F.col("c_acctbal") * 100000 + F.col("c_custkey") % 1000).alias("model"), F.max("c_acctbal").alias("metric"))


@query("SELECT l_returnflag AS scope, sha256(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k)) AS snapshot, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_suppkey AS k FROM lineitem) GROUP BY 1")
def ml_snapshot_ids(t: Tables):
    rows = t.lineitem.select("l_returnflag", F.col("l_suppkey").alias("k")).distinct()
    joined = F.array_join(F.array_sort(F.collect_list("k")).cast("array<string>"), ",")
    return rows.groupBy(F.col("l_returnflag").alias("scope")).agg(F.sha2(joined.cast("binary"), 256).alias("snapshot"), F.count("*").alias("n"))


@query("SELECT 'feature' || CAST(p_size % 12 AS VARCHAR) AS feature, p_brand AS scope, round(avg(p_retailprice), 6) AS attribution, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY avg DESC, f) AS rank FROM (SELECT p_brand, p_size % 12 AS f, round(avg(p_retailprice), 6) AS avg FROM part GROUP BY 1, 2)) GROUP BY ALL".replace("SELECT 'feature' || CAST(p_size % 12 AS VARCHAR) AS feature, p_brand AS scope, round(avg(p_retailprice), 6) AS attribution, rank FROM", "SELECT 'feature' || CAST(f AS VARCHAR) AS feature, p_brand AS scope, avg AS attribution, rank FROM").replace(" GROUP BY ALL", " WHERE rank <= 3"))
def ml_attribution_summary(t: Tables):
    per = t.part.groupBy(F.col("p_brand").alias("scope"), (F.col("p_size") % 12).alias("f")).agg(F.round(F.avg("p_retailprice"), 6).alias("attribution"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("attribution"), "f"))
    return per.withColumn("rank", rank).where("rank <= 3").select(F.concat(F.lit("feature"), F.col("f").cast("string")).alias("feature"), "scope", "attribution", "rank")
