"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; every stage's result is written as Parquet in the shared folder and read
again as the next one's docs. All but the last return the columns of documents,
and leave out other ones, whatever their names. Null texts count as empty, texts
are taken whole, ids may be null or repeat, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import exact_dedup, ngram_join, packing, quality, secret_scan
from loomline.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject. Null and empty texts have one score, rows that repeat all stay or all go; without labels of both classes the share of good ones decides for all."""
    model = quality.fit_table(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score_table(docs.select(COLUMNS), model).where("predicted = 1").select(COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id; null is below all, and of rows equal in id and text the first by the other columns, as JSON, stays."""
    return exact_dedup.keep_one_of_each(docs.select(COLUMNS), keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join, the one with the smallest id; null is above all, ties go by a hash of the text, then by the other columns, as JSON. Documents without words all stay."""
    return ngram_join.keep_one_of_each(docs.select(COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by its kind in brackets and n_chars brought up to date (null for a null text); rows that repeat all stay."""
    return secret_scan.redact(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their sequences; a null or empty text is one piece, rows that repeat are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier and the packing; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
