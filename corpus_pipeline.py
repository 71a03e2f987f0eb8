"""From raw documents to packed training sequences: quality rules, toxicity,
near-duplicates, repeated spans, packing.

Every stage reads what its predecessor kept, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import hostrules, neardup, queries, spans, toxicity
from tracklake.llm.common import passing, stage
from tracklake.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, from hosts that are not rejected."""
    ship_package(spark)
    # stored: a filter on the verdict would otherwise be pushed below the measures and repeat them many times over
    measured = stage(hostrules.document_rules(docs), "measured")
    judged = hostrules.apply_verdicts(measured, hostrules.host_verdicts(measured))
    return judged.filter("kept").select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    ship_package(spark)
    scored = toxicity.score_documents(docs, queries.toxicity_tagger(spark, sf_dir), spans=False)
    return scored.filter("predicted = 0").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    ship_package(spark)
    return neardup.first_of_class(docs).select(docs.columns)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that an earlier document or place has; n_chars follows the text."""
    ship_package(spark)
    left = spans.dedup_spans(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of at most 2048 tokens."""
    ship_package(spark)
    return queries.packed_pieces(docs)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_copies),
    ("substring_dedup", repeated_spans),
    ("packing", packed),
]

# models, hashing and packing are not SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        with passing(spark):  # what a stage has stored is given up with it
            docs = stage(step(spark, docs, sf_dir), name, lasting=True)
    return docs
