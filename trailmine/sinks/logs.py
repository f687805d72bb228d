"""Logs as files: filtered raw logs, and parsed rows kept for further jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmine.functions import text
from trailmine.sources.logs import SIZES


def write_filtered_log(
    lines: DataFrame, folder: str, mode: str = "error", as_scanned: bool = False
) -> None:
    """Lines in a folder for each log file, in their old order, quoted only where needed.

    `sources.logs.read_lines` reads the result like the original.  With ``as_scanned``, where
    nothing has moved lines since the scan, each task writes the blocks that it has read and nothing
    is exchanged: a scan deals the blocks of a file to tasks in their order (all are of one size but
    the last, and it deals larger ones first), and part files are named by task.  Otherwise lines
    are put back into the order of their places.
    """
    placed = lines if as_scanned else lines.repartitionByRange("raw_file", "part", "pos")
    (
        placed.sortWithinPartitions("raw_file", "part", "pos")
        .select("raw_file", text.csv_line(text.csv_fields(F.col("value"))).alias("value"))
        .write.mode(mode)
        .partitionBy("raw_file")
        .text(folder)
    )


def store_rows(rows: DataFrame, folder: str) -> None:
    """Parsed rows as Parquet by unit, so that several jobs parse the text once.

    Places are stored with the rows, so order survives, and each task writes what it has read.  A
    unit that is there already is replaced.
    """
    _replace_units(rows, folder)


def store_session_sizes(sizes: DataFrame, folder: str) -> None:
    """Sizes of large sessions beside stored rows, for jobs that would count them otherwise."""
    _replace_units(sizes.coalesce(1), f"{folder.rstrip('/')}/{SIZES}")


def _replace_units(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "unit"
    ).parquet(folder)
