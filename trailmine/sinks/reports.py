"""Reports and lists as text and JSON, a folder for each sequence length."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trailmine.functions.formats import JSON_FIELDS, LINE_ORDER, report_json, report_lines
from trailmine.operators.reports import LIST_LIMIT, report_lists


def _in_order(df: DataFrame, order: list[str], single_file: bool) -> DataFrame:
    """Sorted over all files; in one file only if asked for, as a report may be small."""
    spread = df.repartition(1) if single_file else df.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order)


def write_text_report(
    rows: DataFrame,
    folder: str,
    single_file: bool = False,
    keep_tags: bool = False,
    mode: str = "error",
) -> None:
    """Blocks of total, topics and one line for each query, in the order of rank.

    ``keep_tags`` leaves the marks of search and topic in front of texts.
    """
    lines = _in_order(report_lines(rows, keep_tags), LINE_ORDER, single_file)
    lines.select("len", "line").write.mode(mode).partitionBy("len").text(folder)


def write_json_report(
    rows: DataFrame,
    folder: str,
    single_file: bool = False,
    list_limit: int = LIST_LIMIT,
    mode: str = "error",
) -> None:
    """One JSON object for each sequence: its count, topics and searches."""
    order = ["len", "rank", "part"]
    objects = _in_order(report_json(report_lists(rows, list_limit)), order, single_file)
    objects.select("len", *JSON_FIELDS).write.mode(mode).partitionBy("len").json(folder)


def write_report(
    rows: DataFrame,
    folder: str,
    output_type: str = "JSON",
    single_file: bool = False,
    mode: str = "error",
    keep_tags: bool = False,
) -> None:
    """``single_file`` puts all lines of the report in one task; ``keep_tags`` is for text alone."""
    if output_type == "TEXT":
        write_text_report(rows, folder, single_file, keep_tags, mode)
    else:
        write_json_report(rows, folder, single_file, mode=mode)


def write_list(
    values: DataFrame, folder: str, single_file: bool = False, mode: str = "error"
) -> None:
    """A one-column DataFrame as text, one value in a line."""
    (values.repartition(1) if single_file else values).write.mode(mode).text(folder)
