"""Labelled events of sessions: kind, text, place in the session, hour, sub-session.

Rows in: ``unit, session_id, event_type, ts, query, title, part, pos``.
Events: ``unit, session_id, is_search, label, ts, part, pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trailmine.functions import text
from trailmine.operators.hot import CHUNK, SESSION, split_hot_sessions


def label_events(rows: DataFrame) -> DataFrame:
    """Keep searches and topic views; the label is the query of a search, else the title.

    A table may hold events without a session; logs cannot.  They take part in no sequence.
    """
    event_type = F.col("event_type")
    is_search = text.is_search_event(event_type)
    kept = text.is_sequence_event(event_type) & F.col("session_id").isNotNull()
    return rows.where(kept).select(
        "unit",
        "session_id",
        is_search.alias("is_search"),
        F.when(is_search, F.col("query")).otherwise(F.col("title")).alias("label"),
        "ts",
        "part",
        "pos",
    )


def session_hour(events: DataFrame) -> DataFrame:
    """Hour of the first event of each session; NULL if its time could not be read.

    Aggregates, combined before the shuffle, so the size of a session does not matter: the first
    event of each part, then the first part.  Numbers and times are all that they keep, which hash
    aggregates can hold; only parts that are names of files and blocks are sorted, one for each
    session and block.
    """
    by_part = events.groupBy(*SESSION, "part").agg(F.min_by("ts", "pos").alias("ts"))
    # `min_by` skips NULL; events without a place come first.
    loose = F.count_if(F.col("part").isNull()) > 0
    return by_part.groupBy(*SESSION).agg(
        F.when(loose, F.max(F.when(F.col("part").isNull(), F.col("ts"))))
        .otherwise(F.min_by("ts", "part")).alias("first_ts")
    ).select(*SESSION, F.hour("first_ts").alias("hour"))


def sessions_without_hour(events: DataFrame) -> DataFrame:
    """Sessions per unit that counting by hour leaves out, because their time is unreadable."""
    return (
        session_hour(events)
        .groupBy("unit")
        .agg(F.count_if(F.col("hour").isNull()).alias("n_sessions"))
    )


def ordered_events(
    events: DataFrame, hot_after: int | None = None, chunk_rows: int | None = None
) -> DataFrame:
    """Sessions as numbered events: ``place`` counts from 1 in the order of the session.

    Chunks of hot sessions are numbered apart; the sizes of the chunks before give the offset.
    """
    spread, hot = split_hot_sessions(events, hot_after, chunk_rows)

    def number(keys: list[str]) -> Column:
        return F.row_number().over(Window.partitionBy(*keys).orderBy("part", "pos")).cast("bigint")

    if hot is None:
        return spread.withColumn("place", number(SESSION))
    before = Window.partitionBy(*SESSION).orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        hot.groupBy(*CHUNK)
        .agg(F.count(F.lit(1)).alias("n_chunk"))
        .select(*CHUNK, F.sum("n_chunk").over(before).alias("offset"))
    )
    return (
        spread.withColumn("within", number(CHUNK))
        .join(offsets, CHUNK, "left")
        .withColumn("place", F.col("within") + F.coalesce("offset", F.lit(0)))
        .drop("chunk", "within", "offset")
    )


def split_sessions_by_gap(
    events: DataFrame,
    threshold_seconds: int,
    hot_after: int | None = None,
    chunk_rows: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Number the sub-sessions of each session from 0 in ``sub_session``.

    A new one starts where two consecutive events are more than ``threshold_seconds`` apart.  An
    event whose time could not be read starts none.  For hot sessions each chunk is summed up to
    its first and last time and its number of starts, and a running sum over chunks gives the
    number to begin with.
    """
    spread, hot = split_hot_sessions(events, hot_after, chunk_rows, sizes=sizes)
    too_long = F.expr(f"make_dt_interval(0, 0, 0, {int(threshold_seconds)})")

    def starts(late: Column, early: Column) -> Column:
        return F.coalesce((late - early > too_long).cast("bigint"), F.lit(0))

    def in_order(keys: list[str]) -> WindowSpec:
        return Window.partitionBy(*keys).orderBy("part", "pos")

    def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        so_far = in_order(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (
            df.withColumn("before", F.lag("ts").over(in_order(keys)))
            .withColumn(name, F.sum(starts(F.col("ts"), F.col("before"))).over(so_far))
        )

    if hot is None:
        return numbered(spread, SESSION, "sub_session").drop("before")
    place = F.struct("part", "pos")
    chunks = (
        hot.withColumn("before", F.lag("ts").over(in_order(CHUNK)))
        .groupBy(*CHUNK)
        .agg(
            F.sum(starts(F.col("ts"), F.col("before"))).alias("inner"),
            F.min_by("ts", place).alias("first_ts"),
            F.max_by("ts", place).alias("last_ts"),
        )
    )
    by_session = Window.partitionBy(*SESSION).orderBy("chunk")
    chunks = chunks.select(
        *CHUNK,
        "inner",
        starts(F.col("first_ts"), F.lag("last_ts").over(by_session)).alias("outer"),
    )
    upto = by_session.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = chunks.select(
        *CHUNK, (F.sum(F.col("inner") + F.col("outer")).over(upto) - F.col("inner")).alias("offset")
    )
    return (
        numbered(spread, CHUNK, "within")
        .join(offsets, CHUNK, "left")
        .withColumn("sub_session", F.col("within") + F.coalesce("offset", F.lit(0)))
        .drop("chunk", "before", "within", "offset")
    )


def as_sessions(events: DataFrame) -> DataFrame:
    """Make each sub-session a session of its own, ready for the sequence operators."""
    return events.withColumn(
        "session_id", F.concat_ws("#", F.col("session_id").cast("string"), "sub_session")
    ).drop("sub_session")
