"""Distinct sessions and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmine.functions import text


def distinct_sessions_by_unit(sessions: DataFrame) -> DataFrame:
    return sessions.select("unit", "session_id").distinct()


def distinct_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id").distinct()


def topic_counts(rows: DataFrame) -> DataFrame:
    """Titles of topic views, spelling kept, and how often each was viewed."""
    views = rows.where(F.col("event_type").contains(text.TOPIC_TYPE))
    return views.groupBy("title").agg(F.count(F.lit(1)).alias("n"))


def distinct_topics_by_unit(rows: DataFrame) -> DataFrame:
    views = rows.where(F.col("event_type").contains(text.TOPIC_TYPE))
    return views.select("unit", "title").distinct()


def distinct_topics(rows: DataFrame) -> DataFrame:
    views = rows.where(F.col("event_type").contains(text.TOPIC_TYPE))
    return views.select("title").distinct()
