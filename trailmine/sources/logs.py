"""Raw session logs: tab-separated text, one event per line, files named ``YYYYMMDD.txt``.

Every row carries its place in the input, because the order of the events of a session is the
order of the lines:

* ``part``: the file and the block of the file that one task reads in sequence,
* ``pos``: a number that rises with the lines of a block.

``(part, pos)`` orders all lines of all files.  ``unit`` is the load unit: the year and month of
the file name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trailmine.functions import text

UNIT_CHARS = 6
# Below stored rows: sizes of large sessions.  Spark does not read names with a line in front as rows.
SIZES = "_session_sizes"
# Folder level written by `sinks.logs.write_filtered_log`, one folder for each original file.
RAW_FILE = "raw_file"

ROW_SCHEMA = (
    "unit string, session_id string, event_type string, ts timestamp_ntz, query string, "
    "title string, part struct<file: string, piece: string, block: bigint>, pos bigint"
)


# A place in stored rows is one number: of the file in its unit, and of the block's first byte in
# files of up to 16 TiB.
BLOCK_BITS = 44
STORED_SCHEMA = ROW_SCHEMA.replace(
    "part struct<file: string, piece: string, block: bigint>", "part bigint"
)


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    skip_units: Iterable[str] = (),
    keep_headers: bool = False,
) -> DataFrame:
    """Lines of all logs below ``path``, with their fields, unit, file and place.

    ``path`` is a folder, a glob or a list of them.  ``skip_units`` leaves whole files out before
    they are opened.  Header lines are dropped wherever they stand.  Both the plain layout
    (``20110131.txt``) and the layout of filtered logs (``raw_file=20110131.txt/part-…``) are read.
    """
    scan = spark.read.option("pathGlobFilter", "*.txt").text(path)
    if RAW_FILE in scan.columns:
        raw_file, piece = F.col(RAW_FILE).cast("string"), _piece(F.col("_metadata.file_name"))
    else:
        raw_file, piece = F.col("_metadata.file_name"), F.lit("")
    unit = F.substring(raw_file, 1, UNIT_CHARS)
    skipped = list(skip_units)
    if skipped:
        scan = scan.where(~unit.isin(skipped))
    if not keep_headers:
        scan = drop_headers(scan)
    return number_lines(
        scan,
        unit.alias("unit"),
        raw_file.alias(RAW_FILE),
        F.struct(
            raw_file.alias("file"),
            piece.alias("piece"),
            F.col("_metadata.file_block_start").alias("block"),
        ).alias("part"),
    )


def _piece(name: Column) -> Column:
    """The name of a part file with the number of its task in as many digits as any has."""
    number = F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 10, "0")
    return F.concat(number, F.lit("-"), name)


def log_files(spark: SparkSession, path: str | list[str]) -> list[tuple[str, str]]:
    """Names of raw files below ``path`` with the part files of filtered logs, from listing alone."""
    try:
        paths = spark.read.option("pathGlobFilter", "*.txt").text(path).inputFiles()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    found = []
    for folder, name in (unquote(p).rsplit("/", 2)[1:] for p in paths):
        filtered = folder.startswith(f"{RAW_FILE}=")
        found.append((folder.split("=", 1)[1], name) if filtered else (name, ""))
    return found


def log_units(spark: SparkSession, path: str | list[str]) -> list[str]:
    return sorted({raw_file[:UNIT_CHARS] for raw_file, _ in log_files(spark, path)})


def with_numbered_parts(
    spark: SparkSession, rows: DataFrame, files: list[tuple[str, str]]
) -> DataFrame:
    """Rows with ``part`` as one number instead of names, in the same order within a unit.

    ``files`` are those of `log_files`; they are listed anyway, and the list is broadcast.
    """
    numbers, at = [], {}
    for raw_file, name in sorted(files, key=lambda f: (f[0], _piece_key(f[1]))):
        unit = raw_file[:UNIT_CHARS]
        at[unit] = at.get(unit, -1) + 1
        numbers.append((raw_file, _piece_key(name), at[unit]))
    table = spark.createDataFrame(numbers, "_file string, _piece string, _number bigint")
    known = (F.col("part.file") == F.col("_file")) & (F.col("part.piece") == F.col("_piece"))
    part = F.shiftleft("_number", BLOCK_BITS).bitwiseOR(F.col("part.block"))
    return rows.join(F.broadcast(table), known).select(
        *[part.alias("part") if c == "part" else F.col(c) for c in rows.columns]
    )


def _piece_key(name: str) -> str:
    """What `_piece` makes of a name."""
    if not name:
        return ""
    found = re.match(r"part-(\d+)", name)
    return f"{found[1][:10].rjust(10, '0') if found else '0' * 10}-{name}"


def number_lines(lines: DataFrame, *columns: Column) -> DataFrame:
    """Lines with the given columns, their ``fields``, and ``pos``, which rises within a task.

    Splitting goes with numbering because filters do not move below the numbering, so no later
    filter makes Spark split a line again.
    """
    return lines.select(
        "value",
        text.tab_fields(F.col("value")).alias("fields"),
        *columns,
        F.monotonically_increasing_id().alias("pos"),
    )


def drop_headers(lines: DataFrame) -> DataFrame:
    return lines.where(~text.is_header(F.col("value")))


def parse_rows(lines: DataFrame) -> DataFrame:
    """Rows of at least seven columns (schema ``ROW_SCHEMA``).

    Numbers are never negative; asking for it keeps the numbering, and with it the one splitting,
    in plans that need no order.
    """
    fields = F.col("fields")
    return lines.where((F.size(fields) >= text.MIN_FIELDS) & (F.col("pos") >= 0)).select(
        "unit",
        fields[0].alias("session_id"),
        fields[3].alias("event_type"),
        text.parse_time(fields[4]).alias("ts"),
        fields[5].alias("query"),
        fields[6].alias("title"),
        "part",
        "pos",
    )


def read_log(
    spark: SparkSession, path: str | list[str], skip_units: Iterable[str] = ()
) -> DataFrame:
    return parse_rows(read_lines(spark, path, skip_units))


def session_ids(lines: DataFrame) -> DataFrame:
    """Unit and session id of every line, short lines and all event types included."""
    ids = lines.select("unit", F.substring_index("value", "\t", 1).alias("session_id"))
    return ids.where(F.col("session_id") != "")


def read_stored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows kept as Parquet by `sinks.logs.store_rows`."""
    return spark.read.schema(STORED_SCHEMA).parquet(folder)


def read_session_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the large sessions of rows kept by `sinks.logs.store_rows`."""
    return spark.read.schema("unit string, session_id string, n_rows bigint").parquet(
        f"{folder.rstrip('/')}/{SIZES}"
    )
