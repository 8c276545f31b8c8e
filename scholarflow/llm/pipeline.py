"""A corpus for training, in five stages, each over all that the one before it kept.

run() applies them to documents; each is written as Parquet to the shared
folder and read again. All but the last return the columns of documents, whatever
these are named.

Documents may have null ids and texts, and rows may repeat: near_dedup keeps one
of rows that are equal in id and text, and rows with one id and different texts
are different documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from . import decontamination, near_dedup, packing, quality_classifier, secrets


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    names = S.free(docs, "score"), S.free(docs, "predicted")
    scored = quality_classifier.classify(docs, S.table(spark, sf_dir, "labels"), names=names)
    return scored.where(F.col(names[1]) == 1).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id (null: after all others); of equal ids that with the smallest hash of its text; of equal rows one."""
    name = S.free(docs, "key")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *S.text_key(F.col("text"))).alias(name)
    named = near_dedup.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    kept = named.where("kept").select(F.col("doc_id").alias(name)).distinct()
    once = docs.select("*", key).join(kept, name, "left_semi").dropDuplicates([name])
    return once.select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.clean(docs, S.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by marks."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and the sequence and place of each."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("secret_scans", redact), ("best_fit_packing", pack)]

#: SQL can't express the classifier's fit; tests hold every stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. A stage's scratch goes when it is written, and so does what it has read."""
    docs, before = S.table(spark, sf_dir, "documents"), S.Scope(spark)
    for name, stage in STAGES:
        after = S.Scope(spark)
        try:
            with S.scope(spark):
                docs = after.save(stage(spark, docs, sf_dir), name)
        finally:
            before.delete()
            before = after
    S.current(spark).adopt(before)
    return docs
