"""Column expressions over log text.  All of them are built-in functions; nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the log and file formats.
HEADER_PREFIX = "Session ID"
TOPIC_TYPE = "TopicView/full"
SEARCH_TYPE = "Search/Lucene"
SEARCH_TAG = "s_"
TOPIC_TAG = "t_"
HOUR_TAG = "h_"
MIN_FIELDS = 7


def is_header(line: Column) -> Column:
    return line.startswith(HEADER_PREFIX)


def tab_fields(line: Column) -> Column:
    """Fields of a line; empty fields at the end do not count."""
    return F.split(F.rtrim(line, F.lit("\t")), "\t")


def is_sequence_event(event_type: Column) -> Column:
    return event_type.contains(TOPIC_TYPE) | event_type.contains(SEARCH_TYPE)


def is_search_event(event_type: Column) -> Column:
    return event_type == SEARCH_TYPE


def parse_time(text: Column) -> Column:
    """``2011-01-31 09:05:00`` to a time without zone, NULL if it cannot be read.

    Single digits and anything after the seconds are accepted.  Text of the usual form is cast,
    which is many times faster than a pattern; what else there is, whatever its width, is read by
    pattern.
    """
    usual = text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")
    core = F.regexp_extract(text, r"^(\d+-\d+-\d+ \d+:\d+:\d+)", 1)
    by_pattern = F.try_to_timestamp(core, F.lit("y-M-d H:m:s")).cast("timestamp_ntz")
    return F.when(usual, text.try_cast("timestamp_ntz")).otherwise(by_pattern)


def csv_fields(line: Column) -> Column:
    """Fields of a tab-separated line in which a field may be quoted and hold tabs.

    A quoted field starts with a double quote; a doubled quote inside stands for one.
    """
    quoted = r'"([^"]*+(?:""[^"]*+)*+)"'
    raw = F.regexp_extract_all(
        F.concat(F.lit("\t"), line), F.lit(rf"\t({quoted}[^\t]*|[^\t]*)"), F.lit(1)
    )
    unquoted = F.transform(
        raw,
        lambda field: F.when(
            field.rlike("^" + quoted),
            F.concat(
                F.replace(F.regexp_extract(field, "^" + quoted, 1), F.lit('""'), F.lit('"')),
                F.regexp_replace(field, "^" + quoted, ""),
            ),
        ).otherwise(field),
    )
    return F.when(line.contains('"'), unquoted).otherwise(F.split(line, "\t"))


def csv_line(fields: Column) -> Column:
    """Fields to a tab-separated line; only fields holding a tab or a quote are quoted."""
    return F.array_join(
        F.transform(
            fields,
            lambda field: F.when(
                field.contains('"') | field.contains("\t"),
                F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"')),
            ).otherwise(field),
        ),
        "\t",
    )


def tagged(tag: str, text: Column) -> Column:
    return F.concat(F.lit(tag), text)


def untagged(text: Column) -> Column:
    return F.substring(text, 3, 2147483647)


def items_with_tag(items: Column, tag: str) -> Column:
    return F.transform(F.filter(items, lambda item: item.startswith(tag)), untagged)
