"""Lines of text and JSON for counted sequences and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmine.functions import text

# Fixed values of the text report.
ARROW = " --> "


def counts_lines(counted: DataFrame) -> DataFrame:
    """``unit`` and ``value``: count, hour if there is one, query and topics, tab-separated."""
    hour = (
        [text.tagged(text.HOUR_TAG, F.col("hour").cast("string"))]
        if "hour" in counted.columns
        else []
    )
    topics = F.transform("topics", lambda topic: text.tagged(text.TOPIC_TAG, topic))
    return counted.select(
        "unit",
        F.concat_ws(
            "\t",
            F.col("n").cast("string"),
            *hour,
            text.tagged(text.SEARCH_TAG, F.col("query")),
            topics,
        ).alias("value"),
    )


def report_lines(rows: DataFrame, keep_tags: bool = False) -> DataFrame:
    """`operators.reports.report_rows` as the lines of a text report.

    ``len, rank, section, down, query, hour, line``, to be put in the order of these columns: the
    total, the topics, a line for each query, an empty line.  No list of queries is built.
    """
    by_hour = "hour" in rows.columns

    def shown(tag: str, value: Column) -> Column:
        return text.tagged(tag, value) if keep_tags else value

    query, n = shown(text.SEARCH_TAG, F.col("query")), F.col("n").cast("string")
    if by_hour:
        line = F.concat(F.lit("- "), query, F.lit(", "), F.col("hour"), F.lit(", "), n)
        down, hour = F.lit(0).cast("bigint"), F.col("hour")
    else:
        line = F.concat(F.lit("("), query, F.lit(","), n, F.lit(")"))
        down, hour = -F.col("n"), F.lit(0)
    queries = rows.select(
        "len", "rank", F.lit(3).alias("section"), down.alias("down"), "query",
        hour.alias("hour"), line.alias("line"),
    )
    topics = F.transform("topics", lambda topic: shown(text.TOPIC_TAG, topic))
    frame = [
        F.concat(F.lit("*** ["), F.col("total").cast("string"), F.lit("]")),
        F.concat(F.array_join(topics, ARROW), F.lit(":")),
        F.lit(""),
    ]
    sections = F.array(
        *[F.struct(F.lit(s).alias("section"), v.alias("line")) for s, v in zip((1, 2, 4), frame)]
    )
    frames = (
        rows.select("len", "rank", "total", "topics").distinct()
        .select("len", "rank", F.inline(sections))
        .select(
            "len", "rank", "section", F.lit(0).cast("bigint").alias("down"),
            F.lit("").alias("query"), F.lit(0).alias("hour"), "line",
        )
    )
    return frames.unionByName(queries)


LINE_ORDER = ["len", "rank", "section", "down", "query", "hour"]


def report_json(lists: DataFrame) -> DataFrame:
    """`operators.reports.report_lists` as columns of the JSON report.

    Every object has ``part`` and ``parts``, whatever the length of its list.
    """
    by_hour = "hour" in lists.schema["queries"].dataType.elementType.fieldNames()

    def entry(q: Column) -> Column:
        hour = [q["hour"].alias("hour")] if by_hour else []
        return F.struct(q["query"].alias("query"), q["n"].alias("count"), *hour)

    return lists.select(
        "len",
        "rank",
        F.col("total").alias("sequenceCount"),
        F.col("topics").alias("sequence"),
        F.transform("queries", entry).alias("searchQueries"),
        "part",
        "parts",
    )


# The fields of a JSON object.
JSON_FIELDS = ["sequenceCount", "sequence", "searchQueries", "part", "parts"]
