"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Defined results for odd rows: a null, empty or blank text fails the quality
rules and goes in the first stage.  Rows without doc_id, lang or source are rows
like any other; null is a language and a source of its own.  Of equal rows, and
of rows whose texts are near duplicates, one stays; rows are told apart by
doc_id and text, so different texts under one doc_id are judged each for itself.
Of ties the row with the smaller doc_id (null last), then text, stays.  A
document that the mix takes twice is two rows of the result.  An empty table
gives no rows.  Columns beyond those of documents are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, jaccard, mixing, quality, secrets
from quillon.llm.common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or an adaptive fence go."""
    return quality.keep(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return jaccard.without_near_duplicates(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked."""
    return secrets.mask_documents(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document taken twice is two rows."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("bpe_encoding", bpe_encoding),
]

#: Component search and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
