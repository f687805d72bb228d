"""Queries over the ``events`` table, one for each operator, and the same questions in SQL.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole table.  Arrays are
joined to text at the end, only to make results easy to compare.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmine.functions import formats, text
from trailmine.operators import distinct, events, filters, reports, sequences
from trailmine.operators.counts import count_sequences, merge_counts
from trailmine.params import SequenceParams
from trailmine.plans.jobs import count_rows, report_counts
from trailmine.sources import logs
from trailmine.sources.counts import parse_counts
from trailmine.sources.tables import read_events

PARAMS = SequenceParams(results_limit=20)
EXACT = SequenceParams(results_limit=20, min_unit_support=1)
GAP_SECONDS = 6 * 3600
# Sessions of more events than this are split in the queries named `…_split`, into chunks of about
# this many events, to show that splitting leaves results alone.
SPLIT = {"hot_after": 10, "chunk_rows": 4}

# Queries in a part of a list in the queries named `…_in_parts`.
PART_ENTRIES = 2

ARROW = formats.ARROW


def _unit() -> Column:
    return F.col("unit").cast("string").alias("unit")


def _topics() -> Column:
    return F.array_join("topics", ARROW).alias("topics")


def _queries(by_hour: bool) -> Column:
    def shown(q: Column) -> Column:
        hour = [q["hour"]] if by_hour else []
        return F.concat_ws(":", q["query"], *hour, q["n"])

    return F.array_join(F.transform("queries", shown), "|").alias("queries")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.label_events(read_events(spark, sf_dir))


def _counted(
    spark: SparkSession, sf_dir: str, by_hour: bool = False, params: SequenceParams = PARAMS
) -> DataFrame:
    return count_rows(read_events(spark, sf_dir), params, by_hour)


def _report(
    spark: SparkSession, sf_dir: str, by_hour: bool = False, params: SequenceParams = PARAMS
) -> DataFrame:
    return report_counts(_counted(spark, sf_dir, by_hour, params), params)


def _ranked(rows: DataFrame) -> DataFrame:
    lists = reports.report_lists(rows)
    shown = _queries("hour" in rows.columns)
    return lists.select("len", "rank", "total", _topics(), "part", "parts", shown)


def _joined(lists: DataFrame, by_hour: bool) -> DataFrame:
    """Lists cut into parts, put together again in the order of the parts."""
    keys = [c for c in ("len", "rank", "total", "topics") if c in lists.columns]
    parts = F.array_sort(F.collect_list(F.struct("part", "queries")))
    whole = lists.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p["queries"])).alias(
        "queries"), (F.max("parts") > 1).alias("split"))
    return whole.select(
        *[c for c in keys if c != "topics"], _topics(), "split", _queries(by_hour)
    )


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as lines of a raw log, with the odd cases that a log has."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    # The line is needed for filters too, and Spark computes it again there, so no JSON parsing.
    k = F.translate("props", '{"k": }', "").cast("int")
    kind = F.col("event_type")
    event_type = (
        F.when(kind == "click", "Search/Lucene")
        .when(kind == "view", "TopicView/full")
        .when(kind == "purchase", "xTopicView/full/y")
        .when(kind == "signup", "Search/Lucene/x")
        .otherwise("topicview/full")
    )
    title = F.when((kind == "click") & (k % 5 == 0), "").otherwise(kind)
    line = F.concat_ws(
        "\t",
        F.col("user_id").cast("string"),
        F.lit("user"),
        F.lit("address"),
        event_type,
        F.substring(F.col("ts").cast("string"), 1, 19),
        F.concat(F.lit("q"), (k % 3).cast("string")),
        title,
        F.when(k % 10 == 0, "more").otherwise(""),
    )
    value = (
        F.when(k == 7, "Session ID\tUser\tIP\tType\tTime\tQuery\tTitle")
        .when(k == 8, F.col("user_id").cast("string"))
        .when(k == 9, "")
        .otherwise(line)
    )
    lines = logs.drop_headers(table.select(value.alias("value"), "ts"))
    unit = F.trunc(F.col("ts").cast("date"), "week")
    return logs.number_lines(lines, unit.alias("unit"), F.col("ts").alias("part"))


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        _unit(), "session_id", F.col("pos").alias("event_id"), "is_search", "label",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_text"),
    )


def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.parse_rows(_log_lines(spark, sf_dir))
    return _sequences_of(events.ordered_events(events.label_events(rows)))


def log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = logs.session_ids(_log_lines(spark, sf_dir))
    return distinct.distinct_sessions_by_unit(ids).select(_unit(), "session_id")


def session_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.session_hour(_events(spark, sf_dir)).select(
        _unit(), "session_id", F.col("hour").alias("session_hour")
    )


def sessions_without_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.parse_rows(_log_lines(spark, sf_dir))
    # As if the times of one kind of event could not be read.
    broken = rows.withColumn("ts", F.when(F.col("title") != "signup", F.col("ts")))
    return events.sessions_without_hour(events.label_events(broken)).select(_unit(), "n_sessions")


def _sequences_of(ordered: DataFrame) -> DataFrame:
    return ordered.select(_unit(), "session_id", "place", "is_search", "label")


def session_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences_of(events.ordered_events(_events(spark, sf_dir)))


def session_sequences_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences_of(events.ordered_events(_events(spark, sf_dir), **SPLIT))


def _ngram_counts(spark: SparkSession, sf_dir: str, **split: int) -> DataFrame:
    ngrams = sequences.session_ngrams(
        _events(spark, sf_dir), PARAMS.min_seq, PARAMS.longest_window(), **split
    )
    tagged = F.transform(
        "items",
        lambda item: F.concat(
            F.when(item["is_search"], text.SEARCH_TAG).otherwise(text.TOPIC_TAG), item["label"]
        ),
    )
    counted = ngrams.groupBy("unit", "items").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_unit(), F.array_join(tagged, ARROW).alias("items"), "n")


def session_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram_counts(spark, sf_dir)


def session_ngrams_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram_counts(spark, sf_dir, **SPLIT)


def session_ngrams_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = PARAMS.longest_window(by_hour=True)
    ngrams = sequences.session_ngrams(_events(spark, sf_dir), PARAMS.min_seq, longest, by_hour=True)
    return _counts_shown(count_sequences(sequences.valid_ngrams(ngrams, longest), 1))


def _anchored_shown(found: DataFrame) -> DataFrame:
    return found.select(_unit(), "session_id", "query", _topics(), "len")


def anchored_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored_shown(sequences.anchored_sequences(_events(spark, sf_dir)))


def anchored_sequences_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored_shown(sequences.anchored_sequences(_events(spark, sf_dir), **SPLIT))


def _counts_shown(counted: DataFrame) -> DataFrame:
    unit = [_unit()] if "unit" in counted.columns else []
    hour = [F.col("hour").alias("session_hour")] if "hour" in counted.columns else []
    return counted.select(*unit, *hour, "query", _topics(), "n")


def sequence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts_shown(_counted(spark, sf_dir))


def sequence_counts_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts_shown(_counted(spark, sf_dir, by_hour=True))


def sequence_counts_by_hour_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = PARAMS.longest_window(by_hour=True)
    found = sequences.anchored_sequences(
        _events(spark, sf_dir), PARAMS.min_seq, longest, by_hour=True, **SPLIT
    )
    return _counts_shown(count_sequences(found))


def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts_shown(merge_counts(_counted(spark, sf_dir)))


def merged_counts_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts_shown(merge_counts(_counted(spark, sf_dir, by_hour=True)))


def _rollup(spark: SparkSession, sf_dir: str, by_hour: bool) -> DataFrame:
    rolled = reports.rollup(merge_counts(_counted(spark, sf_dir, by_hour)), PARAMS)
    return rolled.select("len", "total", _topics(), "part", "parts", _queries(by_hour))


def topic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, by_hour=False)


def topic_rollup_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, by_hour=True)


def search_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_report(spark, sf_dir))


def search_topics_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_report(spark, sf_dir, by_hour=True))


def search_topics_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_report(spark, sf_dir, params=EXACT))


def search_topics_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.anchored_sequences(_events(spark, sf_dir), **SPLIT)
    return _ranked(report_counts(count_sequences(found), PARAMS))


def search_topics_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of more than two queries are cut; their parts in order are the whole list."""
    return _joined(reports.report_lists(_report(spark, sf_dir), PART_ENTRIES), by_hour=False)


def search_topics_by_hour_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = reports.report_lists(_report(spark, sf_dir, by_hour=True), PART_ENTRIES)
    return _joined(lists, by_hour=True)


def topic_rollup_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_counts(_counted(spark, sf_dir))
    return _joined(reports.rollup(merged, PARAMS, PART_ENTRIES), by_hour=False)


def search_topics_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions begin anew after a gap, as set for a job."""
    return _ranked(_report(spark, sf_dir, params=replace(PARAMS, session_threshold=GAP_SECONDS)))


def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of a log in forms of several widths, some of which cannot be read."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    month, day, hour, minute, second = (
        f(F.col("ts")) for f in (F.month, F.day, F.hour, F.minute, F.second)
    )
    short = F.format_string("%d-%d-%d %d:%d:%d", F.year("ts"), month, day, hour, minute, second)
    full = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    form = F.col("event_id") % 6
    written = (
        F.when(form == 0, full).when(form == 1, short)
        .when(form == 2, F.concat(full, F.lit(".25"))).when(form == 3, F.concat(short, F.lit(" CET")))
        .when(form == 4, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("soon"))
    )
    time = text.parse_time(F.col("written"))
    return table.select("event_id", written.alias("written")).select(
        "event_id", "written", F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("time_text")
    )


def search_topics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("len", "rank", "total", _topics(), "query", "n")


def support_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_counts(_counted(spark, sf_dir))
    return reports.support_bands(reports.sequence_totals(merged, PARAMS))


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.row_counts(read_events(spark, sf_dir), _counted(spark, sf_dir), PARAMS)


def distinct_sessions_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = distinct.distinct_sessions_by_unit(read_events(spark, sf_dir))
    return sessions.select(_unit(), "session_id")


def distinct_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_sessions(read_events(spark, sf_dir))


def distinct_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_topics(read_events(spark, sf_dir))


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.topic_counts(read_events(spark, sf_dir))


def _with_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return table.withColumn("raw_file", F.date_format("ts", "yyyyMMdd")).withColumnRenamed(
        "user_id", "session_id"
    )


def _listed(days: DataFrame) -> DataFrame:
    return days.where(F.col("event_type") == "purchase").select("raw_file", "session_id")


def listed_sessions_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _with_day(spark, sf_dir)
    return filters.keep_listed_sessions(days, _listed(days)).select(
        "raw_file", "session_id", "event_id", "event_type", "value"
    )


def listed_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _with_day(spark, sf_dir)
    quoted = F.concat(F.lit('"'), "event_type", F.lit('"'))
    lines = days.select(
        "raw_file",
        F.concat_ws("\t", F.col("session_id").cast("string"), quoted, "props").alias("value"),
    )
    listed = _listed(days).withColumn("session_id", F.col("session_id").cast("string"))
    line = text.csv_line(text.csv_fields(F.col("value")))
    return filters.listed_lines(lines, listed).select("raw_file", line.alias("value"))


def _gaps_shown(split: DataFrame) -> DataFrame:
    return split.select(
        _unit(), "session_id", F.col("pos").alias("event_id"), "sub_session"
    )


def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps_shown(events.split_sessions_by_gap(_events(spark, sf_dir), GAP_SECONDS))


def gap_sessions_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps_shown(events.split_sessions_by_gap(_events(spark, sf_dir), GAP_SECONDS, **SPLIT))


def gap_session_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = events.as_sessions(events.split_sessions_by_gap(_events(spark, sf_dir), GAP_SECONDS))
    return _counts_shown(count_sequences(sequences.anchored_sequences(apart)))


def _text_report(
    spark: SparkSession, sf_dir: str, by_hour: bool = False, keep_tags: bool = False
) -> DataFrame:
    lines = formats.report_lines(_report(spark, sf_dir, by_hour), keep_tags)
    return lines.select("len", "rank", "section", "line")


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_report(spark, sf_dir)


def text_report_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_report(spark, sf_dir, by_hour=True)


def tagged_text_report_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_report(spark, sf_dir, by_hour=True, keep_tags=True)


def _json_report(spark: SparkSession, sf_dir: str, by_hour: bool) -> DataFrame:
    objects = formats.report_json(reports.report_lists(_report(spark, sf_dir, by_hour)))
    return objects.select("len", "rank", F.to_json(F.struct(*formats.JSON_FIELDS)).alias("line"))


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_report(spark, sf_dir, by_hour=False)


def json_report_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_report(spark, sf_dir, by_hour=True)


def counts_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.counts_lines(_counted(spark, sf_dir)).select(_unit(), "value")


def counts_lines_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.counts_lines(_counted(spark, sf_dir, by_hour=True)).select(_unit(), "value")


def counts_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts_shown(parse_counts(formats.counts_lines(_counted(spark, sf_dir))))


def counts_from_lines_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = formats.counts_lines(_counted(spark, sf_dir, by_hour=True))
    return _counts_shown(parse_counts(lines, by_hour=True))


_QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    label_events,
    parsed_log,
    parsed_times,
    log_sessions,
    session_hour,
    sessions_without_hour,
    session_sequences,
    session_sequences_split,
    session_ngrams,
    session_ngrams_split,
    session_ngrams_by_hour,
    anchored_sequences,
    anchored_sequences_split,
    sequence_counts,
    sequence_counts_by_hour,
    sequence_counts_by_hour_split,
    merged_counts,
    merged_counts_by_hour,
    topic_rollup,
    topic_rollup_by_hour,
    topic_rollup_in_parts,
    search_topics,
    search_topics_by_hour,
    search_topics_exact,
    search_topics_split,
    search_topics_in_parts,
    search_topics_by_hour_in_parts,
    search_topics_threshold,
    search_topics_rows,
    support_bands,
    row_counts,
    distinct_sessions_by_unit,
    distinct_sessions,
    distinct_topics,
    topic_counts,
    listed_sessions_only,
    listed_log_lines,
    gap_sessions,
    gap_sessions_split,
    gap_session_sequences,
    text_report,
    text_report_by_hour,
    tagged_text_report_by_hour,
    json_report,
    json_report_by_hour,
    counts_lines,
    counts_lines_by_hour,
    counts_from_lines,
    counts_from_lines_by_hour,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES}
