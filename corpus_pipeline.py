"""A corpus pipeline: language, quality, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
all but the last return the columns of documents.  run() writes each stage's rows to the
shared folder and reads them back.

Null and empty texts go at the first stage.  Rows with a null doc_id are judged by their
texts and never dropped as near copies.  Rows equal in doc_id and text, and rows of one
doc_id with near texts, leave one; different texts of one doc_id all stay.  Columns beside
doc_id and text, whatever their names, are carried along.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.langid import keep_languages
from tidemark.llm.minhash import keep_one_of_each
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import keep_good, train_on
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.secret_scan import redact
from tidemark.llm.storage import cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no learned language: those without a letter, and those that no language fits."""
    return keep_languages(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail a base rule or are probably of low quality."""
    return keep_good(docs, train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; no row goes."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents, placed in sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing)]

#: Trained models and tokenizers can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
