"""Filtering of logs by lists of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmine.functions import text


def keep_listed_sessions(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose session is in the list of the same file; repeated list entries do not matter.

    A semi-join on plain shuffles or, if Spark finds the list small, a broadcast.  Both sides go
    straight into the join, so that adaptive execution can split a hot session.
    """
    return rows.join(listed, ["raw_file", "session_id"], "left_semi")


def listed_lines(lines: DataFrame, listed: DataFrame) -> DataFrame:
    """Whole lines of listed sessions; neither the header rule nor the width rule applies."""
    first = text.csv_fields(F.col("value"))[0]
    return keep_listed_sessions(lines.withColumn("session_id", first), listed)
