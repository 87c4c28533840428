"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet before the next stage
reads it.  All but the last return the columns of documents.

Defined results, in all stages: an empty table gives an empty one; texts are read whole, whatever their length;
extra columns pass through, whatever their names (the last stage keeps one called copies as copies_input).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op3_pii_crf, op5_langid, op6_circulant_minhash, op8_mixing, op9_decontamination
from tessera.llm.columns import cleared, fresh
from tessera.llm.queries import table
from tessera.llm.store import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is plain, and set lang to the language found.

    Null text, text without a letter, and ties of two languages are rejected and go; so do all documents where none is
    labelled.  Null lang and null ids are read like others: a null id counts as training.  Repeated rows get one answer.
    """
    out = fresh(docs, "_langid")
    held = F.coalesce(op5_langid.fold(F.col("doc_id")) == 0, F.lit(False))
    found = op5_langid.identify(docs, op5_langid.fit(docs.where(~held)), out=out)
    return found.where(~F.col(out)["rejected"]).withColumn("lang", F.col(out)["lang_pred"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest doc_id.

    Null text and text without words have no copies and stay.  Rows that repeat a doc_id and its text are one
    document, and one row of them stays; rows that repeat a doc_id with another text are judged by their texts.
    Documents of null id stay unless a copy of theirs has an id.
    """
    hash_, id_, of = fresh(docs, "_hash"), fresh(docs, "_id"), fresh(docs, "_of")
    found = op6_circulant_minhash.near_duplicates(docs)
    gone = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(id_), F.col("hash").alias(of)).distinct()
    left = docs.withColumn(hash_, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(of)), "left_anti")
    return left.dropDuplicates(["doc_id", hash_]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a full window of a benchmark item, or that items cover by a twentieth or more.

    Items shorter than a window count by the twentieth only, so a short phrase drops no long document.  Null text and
    text without words stay; an empty benchmark drops nothing; repeated rows get one answer.
    """
    out = fresh(docs, "_decon")
    found = op9_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), out=out)
    return found.where(~(F.col(out)["contaminated"] | F.col(out)["whole"])).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data; n_chars follows the text.

    No row goes.  Null text stays null, with null n_chars; equal texts get equal masks; where spans overlap, the
    first one's kind is written for all.
    """
    out = fresh(docs, "_pii")
    masked = op3_pii_crf.mask_personal(op3_pii_crf.find_personal(docs, out=out), spans_col=out)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their number of copies in the mix; documents that the mix leaves out are not in it.

    Null text has size 0 and is taken like others of its source; a null source is a source.  Rows that repeat
    doc_id, text and source are one row, with the copies of all.
    """
    mixed = op8_mixing.mix_copies(docs)
    docs = cleared(docs, "copies")
    hash_, source_ = fresh(docs, "_hash"), fresh(docs, "_source")
    id_, of, from_ = fresh(docs, "_id"), fresh(docs, "_of"), fresh(docs, "_from")
    chosen = mixed.groupBy(F.col("id").alias(id_), F.col("hash").alias(of), F.col("source").alias(from_)).agg(F.sum("copies").alias("copies")).where("copies > 0")
    keyed = docs.withColumn(hash_, F.xxhash64("text")).withColumn(source_, F.col("source").cast("string")).dropDuplicates(["doc_id", hash_, source_])
    both = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(of)) & F.col(source_).eqNullSafe(F.col(from_)))
    return both.select(*docs.columns, "copies")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mixing)]

#: Compression, a trained field and seeded hashes can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
