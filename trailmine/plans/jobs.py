"""Jobs in two phases: prepare each load unit, then process all units together.

A job is a pair of functions from DataFrame to DataFrame and a way to write the result.  The first
phase runs once over all units that are not stored yet; the second reads everything stored.

Several jobs over the same logs should name a ``rows_folder``: the text is then parsed once into
Parquet, and each job reads only the columns it needs from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import partial
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trailmine.operators import hot
from trailmine.operators.counts import count_sequences, merge_counts
from trailmine.operators.distinct import (
    distinct_sessions,
    distinct_sessions_by_unit,
    distinct_topics_by_unit,
)
from trailmine.operators.events import as_sessions, label_events, split_sessions_by_gap
from trailmine.operators.filters import listed_lines
from trailmine.operators.reports import report_rows
from trailmine.operators.sequences import anchored_sequences
from trailmine.params import SequenceParams
from trailmine.sinks.counts import folder_exists, mark_units, stored_units, write_by_unit
from trailmine.sinks.logs import store_rows, store_session_sizes, write_filtered_log
from trailmine.sinks.reports import write_list, write_report
from trailmine.sources.counts import COUNTS_SCHEMA, HOUR_COUNTS_SCHEMA
from trailmine.sources.logs import (
    UNIT_CHARS,
    log_files,
    log_units,
    parse_rows,
    read_lines,
    read_session_sizes,
    read_stored_rows,
    session_ids,
    with_numbered_parts,
)
from trailmine.sources.session_lists import YEARS, read_session_lists

# Events above which the size of a session is stored with its rows.
SIZES_ABOVE = 100_000
# Entries of session lists that are broadcast, about 200 MB.
MAX_LISTED = 2_000_000


@dataclass(frozen=True)
class Job:
    """``preprocess`` turns a log into rows with a ``unit``, of the given schema; ``process`` turns
    all of those into the result; ``write`` stores the result.  The log comes as parsed rows, or
    with ``needs_lines`` as lines, those too short to parse included.  A job of sequences
    (``sequences``) is also given the sizes of large sessions where they are stored, as ``sizes``,
    and what to observe its numbers with, as ``stats``."""

    preprocess: Callable[..., DataFrame]
    process: Callable[..., DataFrame]
    write: Callable[[DataFrame, str, SequenceParams, bool, str], None]
    schema: str
    needs_lines: bool = False
    sequences: bool = False


def count_rows(
    rows: DataFrame,
    params: SequenceParams,
    by_hour: bool = False,
    sizes: DataFrame | None = None,
    stats: Observation | None = None,
) -> DataFrame:
    """First phase of the sequence jobs, from parsed rows."""
    events = rows.transform(label_events)
    hot_after = None
    if params.session_threshold is not None:
        if sizes is None:
            sizes = hot.session_sizes(events, hot.HOT_AFTER)
        if not sizes.where(F.col("n_rows") > hot.HOT_AFTER).take(1):
            # No part of a session is larger than the session.
            hot_after = hot.NEVER
        events = split_sessions_by_gap(
            events, params.session_threshold, hot_after, sizes=sizes
        ).transform(as_sessions)
        sizes = None
    return events.transform(
        anchored_sequences, params.min_seq, params.longest_window(by_hour), by_hour,
        hot_after, sizes=sizes, stats=stats,
    ).transform(count_sequences, params.min_unit_support)


def report_counts(
    counted: DataFrame, params: SequenceParams, stats: Observation | None = None
) -> DataFrame:
    """Second phase of the sequence jobs."""
    return counted.transform(merge_counts).transform(report_rows, params, stats)


def _write_report(
    rows: DataFrame, folder: str, params: SequenceParams, single_file: bool, mode: str
) -> None:
    write_report(rows, folder, params.output_type, single_file, mode, params.keep_tags)


def _write_list(
    values: DataFrame, folder: str, params: SequenceParams, single_file: bool, mode: str
) -> None:
    write_list(values, folder, single_file, mode)


# The names of jobs.
JOBS: dict[str, Job] = {
    "SearchTopics": Job(
        partial(count_rows, by_hour=False), report_counts, _write_report, COUNTS_SCHEMA,
        sequences=True,
    ),
    "SearchTopicsByHour": Job(
        partial(count_rows, by_hour=True), report_counts, _write_report, HOUR_COUNTS_SCHEMA,
        sequences=True,
    ),
    "DistinctSession": Job(
        lambda lines, params: distinct_sessions_by_unit(session_ids(lines)),
        lambda sessions, params: distinct_sessions(sessions),
        _write_list,
        "unit string, session_id string",
        needs_lines=True,
    ),
    "DistinctTopics": Job(
        lambda rows, params: distinct_topics_by_unit(rows),
        lambda topics, params: topics.select("title").distinct(),
        _write_list,
        "unit string, title string",
    ),
}


def find_job(action: str, jobs: Mapping[str, Job] = JOBS) -> Job:
    if action not in jobs:
        raise ValueError(f"unknown action {action!r}; known: {', '.join(sorted(jobs))}")
    return jobs[action]


def store_log(spark: SparkSession, raw_folder: str, rows_folder: str) -> None:
    """Parse the units of a log that are not stored as rows yet, and size up their sessions.

    The text is read once and nothing is exchanged; sizes are counted from three columns of what
    is stored.
    """
    done = stored_units(spark, rows_folder)
    files = log_files(spark, raw_folder)
    new = sorted({raw_file[:UNIT_CHARS] for raw_file, _ in files} - set(done))
    if not new:
        return
    rows = parse_rows(read_lines(spark, raw_folder, skip_units=done))
    store_rows(with_numbered_parts(spark, rows, files), rows_folder)
    stored = read_stored_rows(spark, rows_folder).where(F.col("unit").isin(new))
    sizes = hot.session_sizes(label_events(stored), SIZES_ABOVE)
    store_session_sizes(sizes, rows_folder)
    mark_units(spark, rows_folder, new)


def _write_statistics(
    spark: SparkSession, params: SequenceParams, phase: str, found: list[Observation]
) -> None:
    """What a run has observed, as lines ``{"stage", "n"}`` of JSON.

    Spark observes nothing where it finds that a branch is empty before it runs.
    """
    seen = [observation for observation in found if observation._jo.getRow().length()]
    rows = [(name, int(n)) for observation in seen for name, n in observation.get.items()]
    table = spark.createDataFrame(rows, "stage string, n bigint").coalesce(1)
    table.write.mode("overwrite").json(f"{params.job_folder}/statistics/phase={phase}")


def preprocess(
    spark: SparkSession,
    params: SequenceParams,
    jobs: Mapping[str, Job] = JOBS,
    rows_folder: str | None = None,
) -> None:
    """Prepare the units whose results are not done yet, all in one Spark job.

    Units without rows count as done too.  The numbers of rows read, sessions, sessions without an
    hour and rows stored are observed on the way and written to ``statistics``.
    """
    job = find_job(params.action, jobs)
    folder = f"{params.job_folder}/preprocessed"
    skip = stored_units(spark, folder)
    sizes = None
    if rows_folder is None or job.needs_lines:
        new = sorted(set(log_units(spark, params.raw_folder)) - set(skip))
        log = read_lines(spark, params.raw_folder, skip_units=skip)
        log = log if job.needs_lines else parse_rows(log)
    else:
        store_log(spark, params.raw_folder, rows_folder)
        new = sorted(set(stored_units(spark, rows_folder)) - set(skip))
        log = read_stored_rows(spark, rows_folder).where(F.col("unit").isin(new))
        if hot.HOT_AFTER >= SIZES_ABOVE:
            sizes = read_session_sizes(spark, rows_folder).where(F.col("unit").isin(new))
    if not new:
        return
    read, stored, more = Observation(), Observation(), {}
    log = log.observe(read, F.count(F.lit(1)).alias("rows"))
    if job.sequences:
        more = {"sizes": sizes, "stats": Observation()}
    counted = job.preprocess(log, params, **more)
    counted = counted.observe(stored, F.count(F.lit(1)).alias("counted"))
    write_by_unit(counted, folder)
    seen = [read, more["stats"], stored] if job.sequences else [read, stored]
    _write_statistics(spark, params, "preprocess", seen)
    mark_units(spark, folder, new)


def process(
    spark: SparkSession,
    params: SequenceParams,
    jobs: Mapping[str, Job] = JOBS,
    single_file: bool = False,
    keep_existing: bool = True,
) -> None:
    """Write the result of all stored units; by default an existing result stays as it is.

    For sequences the numbers of entries and of sequences in each band of support are observed on
    the way and written to ``statistics``.
    """
    job = find_job(params.action, jobs)
    folder = f"{params.job_folder}/processed"
    if keep_existing and folder_exists(spark, folder):
        return
    stored = spark.read.schema(job.schema).parquet(f"{params.job_folder}/preprocessed")
    more = {"stats": Observation()} if job.sequences else {}
    result = job.process(stored, params, **more)
    job.write(result, folder, params, single_file, "ignore" if keep_existing else "overwrite")
    if more:
        _write_statistics(spark, params, "process", [more["stats"]])


def run(
    spark: SparkSession,
    params: SequenceParams,
    jobs: Mapping[str, Job] = JOBS,
    single_file: bool = False,
    keep_existing: bool = True,
    rows_folder: str | None = None,
) -> None:
    preprocess(spark, params, jobs, rows_folder)
    process(spark, params, jobs, single_file, keep_existing)


def filter_log(
    spark: SparkSession,
    lists_folder: str,
    raw_folder: str,
    output_folder: str,
    years: Iterable[str] = YEARS,
) -> None:
    """Write the lines of listed sessions, file by file; only files that have a list are read, and
    lists without a file are passed over.

    Up to ``MAX_LISTED`` list entries are broadcast, so that lines stay where they are scanned;
    with more, lines are joined and ordered by exchanges.
    """
    listed = read_session_lists(spark, lists_folder, years)
    names = {unquote(path).rsplit("/", 1)[1][1:] for path in listed.inputFiles()}
    folder = raw_folder.rstrip("/")
    there = sorted(names & {raw_file for raw_file, _ in log_files(spark, folder)})
    if not there:
        return
    few = listed.count() <= MAX_LISTED
    lines = read_lines(spark, [f"{folder}/{name}" for name in there], keep_headers=True)
    kept = listed_lines(lines, F.broadcast(listed) if few else listed)
    write_filtered_log(kept, output_folder, as_scanned=few)
