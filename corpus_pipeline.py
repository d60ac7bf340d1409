"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, stored as Parquet. All but the last return the columns of
documents. The stages follow the operators' defined results for nulls, empty texts and repeated rows.
Each stage has the session send Python batches of a few MB.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lexgrove.llm import ngram_jaccard, packing, quality_classifier, scratch, secrets, substring_dedup
from lexgrove.llm.queries import table, tokenizer_file

BATCH = scratch.BATCH

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage; from then on batches for Python are bounded."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 stays."""
    return ngram_jaccard.keep_one(docs, size=5, percent=80)


@in_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under 20-word windows that occur earlier go from the text."""
    return substring_dedup.dedup_documents(docs, size=20)


@in_small_batches
def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text give way to their kind in brackets."""
    return secrets.redact_documents(docs)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secret_masks),
    ("best-fit packing", packed),
]

#: SQL can't express a trained model, so tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage has read is removed once its result is stored."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = scratch.stored(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if read:
            scratch.drop(spark, read)
        read = path
    return docs
