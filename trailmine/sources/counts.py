"""Counted sequences written by the first phase, as Parquet or as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmine.functions import text

COUNTS_SCHEMA = "unit string, query string, topics array<string>, len int, n bigint"
HOUR_COUNTS_SCHEMA = "unit string, hour int, query string, topics array<string>, len int, n bigint"


def read_counts(spark: SparkSession, folder: str, by_hour: bool = False) -> DataFrame:
    return spark.read.schema(HOUR_COUNTS_SCHEMA if by_hour else COUNTS_SCHEMA).parquet(folder)


def parse_counts(lines: DataFrame, by_hour: bool = False) -> DataFrame:
    """Lines ``count, [h_hour,] s_query, t_topic…`` to columns."""
    parsed = lines.withColumn("fields", F.split("value", "\t")).select(
        "*", F.slice("fields", 2, F.size("fields") - 1).alias("items")
    )
    hour = text.items_with_tag(F.col("items"), text.HOUR_TAG)[0].cast("int").alias("hour")
    topics = text.items_with_tag(F.col("items"), text.TOPIC_TAG)
    return parsed.select(
        *([F.col("unit")] if "unit" in lines.columns else []),
        *([hour] if by_hour else []),
        text.items_with_tag(F.col("items"), text.SEARCH_TAG)[0].alias("query"),
        topics.alias("topics"),
        F.size(topics).alias("len"),
        F.col("fields")[0].cast("bigint").alias("n"),
    )


def read_counts_tsv(spark: SparkSession, folder: str, by_hour: bool = False) -> DataFrame:
    lines = spark.read.schema("value string, unit string").text(folder)
    return parse_counts(lines, by_hour)
