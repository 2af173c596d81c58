"""A corpus pipeline: quality, language, near-duplicates, packing; each stage calls one operator of goldweave.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm import langid, neardup, packing, quality
from goldweave.llm.common import prepare, stage, table
from goldweave.llm.sampling import bucket

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Score from which the quality classifier keeps a document.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to this input and the labels table, does not reject.

    A null text counts as empty; a null id is not learned from; repeated rows are judged alike; an empty table gives no rows.
    """
    prepare(spark)
    docs = docs.select(*COLUMNS)
    learned = bucket(F.col("doc_id"), 5) != 0
    model = quality.train(docs.where(learned), table(spark, sf_dir, "labels", "doc_id", "quality").where(learned))
    return quality.score_texts(docs, model).where(F.col("score") >= QUALITY).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter and those between two languages are rejected.

    Null and empty texts go; repeated rows are judged alike; without any labelled row all go; an empty table gives no rows.
    """
    prepare(spark)
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(bucket(F.col("doc_id"), 4) != 2))
    return langid.predict(docs, model).where("lang_pred <> 'und' and not ambiguous").select(*COLUMNS)


def _own_ids(docs: DataFrame) -> DataFrame:
    """docs, each different row once, with an own id in `_row`: its doc_id, or where an id has several rows a hash of id and text."""
    many = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if many.isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    many = stage(many, "repeated")
    once = docs.join(many, "doc_id", "left_anti").withColumn("_row", F.col("doc_id"))
    rest = docs.join(many, "doc_id", "left_semi").withColumn("_row", F.xxhash64("doc_id", "text"))
    return stage(once.unionByName(rest.dropDuplicates(["_row"])), "rows")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Rows decide, not ids: of equal rows one stays, and of several texts with one id each is compared on its own. Texts
    without words and rows without an id are no duplicates of anything; an empty table gives no rows.
    """
    prepare(spark)
    docs = _own_ids(docs.select(*COLUMNS))
    gone = neardup.near_duplicates(docs.selectExpr("_row doc_id", "text")).where("not kept").select(F.col("doc_id").alias("_row")).distinct()
    return docs.join(gone, "_row", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens. A null text is a piece of one token; repeated rows are packed each; an empty table gives no rows."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("language ID", language_stage), ("near-duplicates", dedup_stage), ("packing", packing_stage)]

#: SQL can't express trained classifiers and tokenizers; the pipeline is tested against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
