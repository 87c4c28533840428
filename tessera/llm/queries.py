r"""The queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_chat, op2_suffix_tree, op3_pii_crf, op4_secrets, op5_langid, op6_circulant_minhash, op7_telephony, op8_mixing, op9_decontamination, op10_rollups
from .store import shared_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def _spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = op1_chat.read_back(op1_chat.windows(rows.unionByName(extra)))
    digest = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(digest).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), sha(F.col("learned")).alias("loss_sha256"), "formatted_chars")


def op2_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(op5_langid.fold(F.col("doc_id")) == 1, F.lit(False))
    fitted = op2_suffix_tree.fit(docs.where(~held))
    scored = op2_suffix_tree.score(docs, fitted)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(op5_langid.fold(F.col("id")) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(fitted.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = op3_pii_crf.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rules = F.filter("pii", lambda s: s["rule"])
    return docs.select("doc_id", *[_count(rules, k) for k in op3_pii_crf.KINDS], sha(_spans(rules)).alias("base_sha256"), _spans(F.col("pii")).alias("spans"), (F.size("pii") - F.size(rules)).cast("long").alias("n_added"), F.size(F.filter("pii", lambda s: s["field"])).cast("long").alias("n_field"))


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = op4_secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rules = F.filter("secrets", lambda s: s["kind"] != "random")
    return docs.select("doc_id", *[_count(rules, k) for k in op4_secrets.KINDS[:3]], sha(_spans(rules)).alias("base_sha256"), _spans(F.col("secrets")).alias("spans"), _count(F.col("secrets"), "random"), F.size(F.filter(rules, lambda s: s["random"])).cast("long").alias("n_rules_random"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(op5_langid.fold(F.col("doc_id")) == 0, F.lit(False))
    found = op5_langid.identify(docs.select("doc_id", "text"), op5_langid.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "langid.lang_pred", "langid.score", "langid.rejected")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op6_circulant_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_telephony_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are stored as audio files in a table; the files are read back from it, decoded and resampled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = op7_telephony.store(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    audio = op7_telephony.load(written(stored, "telephony-media"))
    payload, media = F.col("audio.payload"), F.col("media")
    kind = F.element_at(F.create_map(*[F.lit(x) for k, tag in op7_telephony.TAGS.items() for x in (f"{tag:02X}", k)]), F.hex(F.substring(media, 21, 1)))
    feature = F.concat_ws(":", kind, *[F.col(f"audio.{k}").cast("string") for k in ("samples", "rms", "peak", "crossings")], F.crc32("audio.pcm").cast("string"))
    tail = F.substring(payload, -64, 64)
    return audio.select("doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"), feature.alias("feature"), F.octet_length("audio.pcm").cast("long").alias("pcm_bytes"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op8_mixing.mix_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op9_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = op9_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    d = F.col("decon")
    return found.select("doc_id", d["n_words"].alias("n_words"), d["n_hit"].alias("n_hit"), F.size(d["items"]).cast("long").alias("n_items"), sha(F.array_join(d["items"], ",")).alias("items_sha256"), d["contaminated"].alias("contaminated"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: inserts under two tokenizer versions, deletion of documents labelled toxic,
    revised counts of documents labelled low in quality (repeated lines left out), and the deletion sent a second time."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    bpe = op10_rollups.bpe_tokens(spark)
    fewer = F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")
    # Texts are counted where they are read, shortened ones a second time; only the counts meet the labels.
    less = F.octet_length(fewer) < F.octet_length("text")
    slim = docs.select("doc_id", "source", "lang", op10_rollups.word_tokens(F.col("text")).alias("words"), op10_rollups.word_tokens(fewer).alias("fewer_words"), bpe(F.col("text")).alias("bpe"), less.alias("less"), bpe(F.when(less, fewer)).alias("fewer_bpe"))
    slim = slim.withColumn("fewer_bpe", F.when(F.col("less"), F.col("fewer_bpe")).otherwise(F.col("bpe")))
    counted = written(written(slim, "rollup-texts").join(labels, "doc_id", "left").drop("doc_id"), "rollup-counts")
    rollup = op10_rollups.Rollup(spark, f"{shared_dir(spark)}/tessera/rollup-{uuid.uuid4().hex}")
    by = (F.col("source"), F.col("lang"))
    versions = (("words-1", "words"), ("byte-bpe-50k", "bpe"))

    def of(rows: DataFrame, op: str) -> DataFrame:
        a, b = (op10_rollups.changes(rows, op, *by, F.lit(v), F.col(c)) for v, c in versions)
        return a.unionByName(b)

    rollup.commit("1-insert", of(counted, "insert"))
    rollup.commit("2-delete", of(counted.where("toxic = 1"), "delete"))
    low = counted.where("quality = 0 and coalesce(toxic, 0) <> 1")
    revised = [op10_rollups.changes(low, "revise", *by, F.lit(v), F.col(f"fewer_{c}"), F.col(c)) for v, c in versions]
    rollup.commit("3-revise", revised[0].unionByName(revised[1]))
    rollup.commit("2-delete", of(counted.where("toxic = 1"), "delete"))
    return rollup.totals().select("source", "lang", "tokenizer", F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_windows, op2_suffix_tree_score, op3_pii_spans, op4_secret_spans, op5_language, op6_near_duplicates, op7_telephony_columns, op8_source_mix, op9_benchmark_overlap, op10_token_rollup)}


FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({FOLD}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' |'] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(c) AS c FROM r GROUP BY 1) m ON m.node = d.doc_id"""
OVERLAP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({FOLD}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(coalesce({FOLD}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM b)),
x AS (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
o AS (SELECT x.doc_id, x.p, x.k, i.item_id FROM x JOIN i ON i.k = x.k AND i.g = x.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM o) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against plain versions."""
    return {"op6_near_duplicates": NEAR.strip(), "op9_benchmark_overlap": OVERLAP.strip()}
