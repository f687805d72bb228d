"""Event tables with a time column as session logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmine.functions import text


def rows_from_events(events: DataFrame) -> DataFrame:
    """The ``events`` table as log rows.

    A session is a user, a click is a search, every other event views the topic named by its type.
    The query text is taken from ``props``; it comes in two spellings so that folding matters.
    The load unit is the week, named by its Monday, a date.  Events are ordered by ``(ts, event_id)``.
    """
    is_click = "event_type = 'click'"
    k = "CAST(get_json_object(props, '$.k') AS int)"
    query = f"IF({k} % 2 = 0, 'Q', 'q') || CAST({k} % 3 AS string)"
    return events.selectExpr(
        "trunc(CAST(ts AS date), 'week') AS unit",
        "user_id AS session_id",
        f"IF({is_click}, '{text.SEARCH_TYPE}', '{text.TOPIC_TYPE}') AS event_type",
        "ts",
        f"IF({is_click}, {query}, '') AS query",
        f"IF({is_click}, '', event_type) AS title",
        "ts AS part",
        "event_id AS pos",
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
