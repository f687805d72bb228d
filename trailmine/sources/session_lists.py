"""Lists of sessions to keep: one tab-separated file for each log file, in a folder per year.

The file name is that of the log file with one more character in front (``c20110131.txt``); the
session id is the first column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmine.functions import text

# The years that have lists.
YEARS = ("2011", "2012")


def read_session_lists(
    spark: SparkSession, folder: str, years: Iterable[str] = YEARS
) -> DataFrame:
    """``(raw_file, session_id)``; repeated ids may remain, a semi-join does not mind them."""
    lines = spark.read.text([f"{folder.rstrip('/')}/{year}" for year in years])
    return lines.where(F.col("value") != "").select(
        F.substring(F.col("_metadata.file_name"), 2, 2147483647).alias("raw_file"),
        text.csv_fields(F.col("value"))[0].alias("session_id"),
    )
