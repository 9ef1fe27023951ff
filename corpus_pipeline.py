"""A training-data pipeline over ``documents``: language, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of ``documents``.

Cases: null and empty texts go with language identification.  The near-duplicate
stage judges each row by its own text: rows with null ids are copies of each
other as any, rows with one id and one text are one document, and different
texts with one id stay unless they are near copies.  Extra columns are kept
until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, few, fresh, read
from inkwell.llm.op2_minhash import BROADCAST_ROWS, near_duplicates
from inkwell.llm.op4_pii import mask_pii
from inkwell.llm.op7_packing import pack
from inkwell.llm.op8_langid import accepted_documents
from inkwell.llm.op10_mixing import mixed_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return accepted_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id, null last."""
    scratch = Scratch(spark, "dedup")
    by_id, by_text, own, place = fresh(docs.columns, "__id", "__th", "__own", "__place")
    found = near_duplicates(docs, by_row=True).select(F.col("doc_id").alias(by_id), F.col("th").alias(by_text), "n_shingles", "kept")
    rows = docs.count()
    found = scratch.cut(few(found, rows))
    left = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(by_id)) & (F.col(own) == F.col(by_text))
    dropped = found.where("not kept").select(by_id, by_text).distinct()
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    left = left.join(dropped, same, "left_anti")
    # Rows that repeat a kept one, if there are any; texts without words are no copies of each other.
    again = found.where(F.col("kept") & (F.col(by_id).isNotNull() | (F.col("n_shingles") > 0))).groupBy(by_id, by_text).count().where("count > 1")
    again = scratch.cut(few(again.select(by_id, by_text), rows))
    if again.isEmpty():
        return left.select(*docs.columns)
    once = Window.partitionBy("doc_id", own).orderBy("text")
    one = left.join(again, same, "left_semi").withColumn(place, F.row_number().over(once)).where(F.col(place) == 1)
    return left.join(again, same, "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each time that words of a document are taken."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: The language model, the network and MinHash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
