"""Counting of sequences: per load unit, then over units and spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hour(df: DataFrame) -> list[str]:
    return ["hour"] if "hour" in df.columns else []


def count_sequences(sequences: DataFrame, min_unit_support: int = 2) -> DataFrame:
    """Occurrences ``n`` of each sequence in each unit, at least ``min_unit_support``.

    Spelling counts here: the cut comes before case is folded.  With an ``hour`` column the hour
    is part of the key.
    """
    keys = ["unit", *_hour(sequences), "query", "topics", "len"]
    counted = sequences.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_unit_support)


def merge_counts(counted: DataFrame) -> DataFrame:
    """Fold case and add the counts over units and spellings.

    ``len`` follows from the topics; it is a key so that a filter on it goes below the aggregates.
    """
    return counted.groupBy(
        *_hour(counted),
        F.lower("query").alias("query"),
        F.transform("topics", F.lower).alias("topics"),
        "len",
    ).agg(F.sum("n").alias("n"))
