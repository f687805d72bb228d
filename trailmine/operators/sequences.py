"""Sequences of consecutive events.

Each event looks back at the few events before it in its session, so a session is never gathered
into one row, and the work is linear in the number of events.  Sessions are ordered once, in one
exchange on the session.

Hot sessions are cut into chunks.  A sequence that lies in one chunk is found there; one that
crosses chunks lies wholly in the outermost ``longest - 1`` events at either end of its chunks, so
those events are put together by session and only sequences that do cross are kept.  No sequence is
found twice or lost, wherever the cuts are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trailmine.operators.hot import CHUNK, SESSION, split_hot_sessions


def _look_back(
    events: DataFrame, keys: list[str], chunk: str, longest: int, *columns: str
) -> DataFrame:
    """Unit, session, ``recent`` (this event and the up to ``longest - 1`` before), ``columns``."""
    recent = (
        f"collect_list(struct(is_search, label, {chunk} AS chunk)) "
        f"OVER (PARTITION BY {', '.join(keys)} "
        f"ORDER BY part, pos ROWS BETWEEN {longest - 1} PRECEDING AND CURRENT ROW) AS recent"
    )
    return events.selectExpr(*SESSION, recent, *columns)


def _chunk_ends(hot: DataFrame, longest: int) -> DataFrame:
    """Events with fewer than ``longest - 1`` events before or after them in their chunk."""
    order = f"OVER (PARTITION BY {', '.join(CHUNK)} ORDER BY part, pos)"
    reach = longest - 1
    return hot.selectExpr(
        "*", f"lag(1, {reach}) {order} AS before", f"lead(1, {reach}) {order} AS after"
    ).where("before IS NULL OR after IS NULL")


def _recent_runs(
    events: DataFrame,
    longest: int,
    expand: Callable[[DataFrame], DataFrame],
    by_hour: bool,
    hot_after: int | None,
    chunk_rows: int | None,
    sizes: DataFrame | None,
    stats: Observation | None,
) -> DataFrame:
    """Runs of events ending at each event, as ``expand`` picks them from ``recent``.

    ``expand`` adds ``run``, an array of events, to a DataFrame with ``recent``.  ``stats`` observes
    the number of sessions and of those without an hour.
    """
    spread, hot = split_hot_sessions(events, hot_after, chunk_rows, by_hour, sizes)
    keys, chunk = (SESSION, "NULL") if hot is None else (CHUNK, "chunk")
    start, hour = [], []
    if by_hour:
        first = (
            f"first(ts) OVER (PARTITION BY {', '.join(keys)} ORDER BY part, pos "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        )
        start = [f"hour({first if hot is None else f'IF(chunk IS NULL, {first}, start_ts)'}) AS hour"]
        hour = ["hour"]
    keep = [*SESSION, *hour, "run"]
    looked = _look_back(spread, keys, chunk, longest, *start)
    if stats is not None:
        # Only the first event of a session looks back at nothing but itself.
        first = "size(recent) = 1 AND coalesce(recent[0].chunk, 0) = 0"
        lost = f"{first} AND hour IS NULL" if by_hour else "false"
        looked = looked.observe(
            stats, F.expr(f"count_if({first}) AS sessions"),
            F.expr(f"count_if({lost}) AS sessions_without_hour"),
        )
    found = expand(looked).select(*keep)
    if longest > 1 and hot is not None:
        start = ["hour(start_ts) AS hour"] if by_hour else []
        ends = expand(_look_back(_chunk_ends(hot, longest), SESSION, chunk, longest, *start))
        crossing = ends.where("run[0].chunk < element_at(run, -1).chunk")
        found = found.unionAll(crossing.select(*keep))
    return found.where("hour IS NOT NULL") if by_hour else found


def anchored_sequences(
    events: DataFrame,
    min_seq: int = 2,
    longest: int = 5,
    by_hour: bool = False,
    hot_after: int | None = None,
    chunk_rows: int | None = None,
    sizes: DataFrame | None = None,
    stats: Observation | None = None,
) -> DataFrame:
    """Every search with the next topics, ``min_seq`` to ``longest`` events, uninterrupted.

    At most one such sequence ends at an event: the one that starts at the last search.
    Returns ``unit, session_id, query, topics, len`` and with ``by_hour`` the hour of the session.
    """
    # How many events back the last search is, 1 for this event; NULL if it is out of reach.
    back = [f"IF(try_element_at(recent, -{n}).is_search, {n}, NULL)" for n in range(1, longest + 1)]

    def expand(df: DataFrame) -> DataFrame:
        known = df.selectExpr("*", f"coalesce({', '.join(back)}) AS n").where(f"n >= {min_seq}")
        return known.selectExpr("*", "slice(recent, -n, n) AS run")

    runs = _recent_runs(events, longest, expand, by_hour, hot_after, chunk_rows, sizes, stats)
    labelled = runs.selectExpr(*SESSION, *(["hour"] if by_hour else []), "run.label AS labels")
    return _query_and_topics(labelled, longest)


def _query_and_topics(labelled: DataFrame, longest: int) -> DataFrame:
    """Take ``labels`` apart.

    The number of topics is known here, and cheaper to filter on than the array.
    """
    return labelled.selectExpr(
        *[column for column in labelled.columns if column != "labels"],
        "labels[0] AS query",
        f"coalesce(slice(labels, 2, {longest}), CAST(array() AS array<string>)) AS topics",
        "size(labels) - 1 AS len",
    )


def session_ngrams(
    events: DataFrame,
    min_seq: int = 2,
    longest: int = 5,
    by_hour: bool = False,
    hot_after: int | None = None,
    chunk_rows: int | None = None,
    sizes: DataFrame | None = None,
    stats: Observation | None = None,
) -> DataFrame:
    """Every run of ``min_seq`` to ``longest`` consecutive events of a session.

    Returns ``unit, session_id, items`` with items ``(is_search, label)``, and with ``by_hour``
    the hour of the session.
    """

    runs = [
        f"IF(size(recent) >= {n}, slice(recent, -{n}, {n}), NULL)"
        for n in range(min_seq, longest + 1)
    ]

    def expand(df: DataFrame) -> DataFrame:
        return df.selectExpr("*", f"explode(array_compact(array({', '.join(runs)}))) AS run")

    found = _recent_runs(events, longest, expand, by_hour, hot_after, chunk_rows, sizes, stats)
    return found.selectExpr(
        *SESSION,
        *(["hour"] if by_hour else []),
        "arrays_zip(run.is_search, run.label) AS items",
    )


def starts_with_only_search(items: Column, longest: int) -> Column:
    """Whether a run starts with a search and holds no other."""
    others = [
        F.coalesce(F.get(items, F.lit(i))["is_search"], F.lit(False)) for i in range(1, longest)
    ]
    return items[0]["is_search"] & ~reduce(lambda a, b: a | b, others, F.lit(False))


def valid_ngrams(ngrams: DataFrame, longest: int = 5) -> DataFrame:
    """Runs that start with their only search, in the form of `anchored_sequences`."""
    valid = ngrams.where(starts_with_only_search(F.col("items"), longest))
    others = [column for column in ngrams.columns if column != "items"]
    return _query_and_topics(valid.selectExpr(*others, "items.label AS labels"), longest)
