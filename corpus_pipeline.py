"""A corpus pipeline: each stage reads the documents that the one before it kept.

Toxic documents go, then copies, then all but one of each group of near copies.  What is left is
mixed to target weights by source and packed into sequences.  The first four stages return the
columns of ``documents``; the last returns pieces with their places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmine.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from trailmine.llm.common import give_back, settle
from trailmine.llm.queries import WORD_TOKENIZER, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    model = toxicity_model(spark, docs, sf_dir)
    return docs.where(toxicity.toxic_score(model, F.col("text")) < toxicity.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same normalised text, the one of the lowest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles, the one of the lowest id.

    Documents without words are linked with nothing and stay.
    """
    return jaccard_join.one_of_each_component(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or what is taken of them, as often as the mix takes them."""
    rows = mixing.numbered(docs)
    return mixing.mixed_documents(rows, mixing.mix_sources(rows))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, with the sequence and the offset of each."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_to_weights),
    ("best_fit_packing", pack_sequences),
]

# Learned scores and tokens have no form in SQL; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        give_back()  # what the stage held in the driver
    return STAGES[-1][1](spark, docs, sf_dir)
