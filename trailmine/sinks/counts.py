"""Counted sequences of the first phase, stored by load unit."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from trailmine.functions.formats import counts_lines


# Below stored results: the units that are done, those without rows too.
DONE = "_units"


def _read_or_none(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def stored_units(spark: SparkSession, folder: str) -> list[str]:
    """Units that are done, there is one for each month of logs: those with a folder, by listing
    files, and those of the list of units.  No data file is opened."""
    stored = _read_or_none(spark, folder, "unit string")
    if stored is None:
        return []
    paths = [unquote(path).split("/") for path in stored.inputFiles()]
    units = {level[5:] for path in paths for level in path[:-1] if level.startswith("unit=")}
    done = _read_or_none(spark, f"{folder.rstrip('/')}/{DONE}", "done string")
    if done is not None:
        units |= {row["done"] for row in done.collect()}
    return sorted(units)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    return _read_or_none(spark, folder, "unit string") is not None


def mark_units(spark: SparkSession, folder: str, units: Iterable[str]) -> None:
    """Put units on the list of those that are done, after their rows are written."""
    done = spark.createDataFrame([(unit,) for unit in units], "done string")
    done.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/{DONE}")


def write_by_unit(stored: DataFrame, folder: str) -> None:
    """Add units to a folder of Parquet files.

    The rebalancing gathers each unit in few files and lets adaptive execution split a large one.
    A unit that is there already is replaced, so a job that is run again does not double it.
    """
    (
        stored.hint("rebalance", "unit")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("unit")
        .parquet(folder)
    )


def export_counts_tsv(counted: DataFrame, folder: str, single_file: bool = False) -> None:
    """Tab-separated text ``count, [h_hour,] s_query, t_topic…``, a folder for each unit."""
    lines = counts_lines(counted)
    lines = lines.repartition(1) if single_file else lines.hint("rebalance", "unit")
    lines.write.mode("overwrite").partitionBy("unit").text(folder)
