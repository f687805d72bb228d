"""Splitting of hot keys: a key that holds a large share of all rows must not land in one task.

The pattern is the same everywhere.  A narrow count per key, combined before its shuffle, finds the
keys above a threshold.  At most ``MAX_HOT`` of them are kept, the largest first, so the list is
small whatever the input and can be broadcast.  Keys on the list are processed in pieces.  A key
above the threshold that is not on the list holds at most one row in ``MAX_HOT`` of all rows, and is
processed whole.  Either way every row is processed and the result is the same.

Whether any session is hot is looked up once, when the plan is built, so that a plan over ordinary
sessions has no branches for pieces at all.  With sizes written beside the rows (`sinks.logs`) that
look-up reads no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_HOT = 100_000
# Events of one session in one unit above which the session is cut into chunks.
HOT_AFTER = 1_000_000
# As `hot_after`: no session is cut, and none is counted.
NEVER = 1 << 62
# Events aimed at in a chunk, and events of a chunk that its bounds are chosen from.
CHUNK_ROWS = 50_000
CHUNK_SAMPLE = 1_000
# Chunks of all hot sessions; with more events chunks are larger.
MAX_CHUNKS = 50_000

SESSION = ["unit", "session_id"]
CHUNK = [*SESSION, "chunk"]


def hot_keys(df: DataFrame, keys: list[str], more_than: int, *aggs: Column) -> DataFrame:
    """Keys with more than ``more_than`` rows, and their ``n_rows``."""
    return largest(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *aggs), keys, "n_rows", more_than
    )


def largest(counted: DataFrame, keys: list[str], size: str, more_than: int) -> DataFrame:
    """The at most ``MAX_HOT`` largest keys above a size.  Ties are broken by the key."""
    return counted.where(F.col(size) > more_than).orderBy(F.desc(size), *keys).limit(MAX_HOT)


def session_sizes(events: DataFrame, more_than: int) -> DataFrame:
    """``unit, session_id, n_rows`` of the sessions that may be hot."""
    return hot_keys(events, SESSION, more_than)


def number_below(bounds: str, place: str) -> str:
    """How many of the sorted ``bounds`` are not above ``place``: a binary search, as an expression."""
    step = "shiftleft(1, bit)"
    return (
        f"aggregate(sequence(int(floor(log2(size({bounds}) + 1))), 0, -1), 0, (at, bit) -> "
        f"IF(at + {step} <= size({bounds}) AND get({bounds}, at + {step} - 1) <= {place}, "
        f"at + {step}, at))"
    )


def _chunk_bounds(events: DataFrame, hot: DataFrame, chunk_rows: int) -> DataFrame:
    """``hot`` with ``bounds``: the first places of all chunks of a session but the first one.

    They are every so manieth place of a sample that a hash decides on, so bursts get as many
    chunks as they have events, and each run has the same.  Events are told apart by
    ``(part, pos)``; those alike in both cannot be parted.
    """
    total = F.sum("n_rows").over(Window.partitionBy())
    aim = F.greatest(F.lit(chunk_rows), F.ceil(total / MAX_CHUNKS))
    aimed = hot.withColumn("aim", aim.cast("bigint")).selectExpr(
        "*", f"greatest(1L, aim div {CHUNK_SAMPLE}) AS one_in"
    )
    in_order = ", ".join(SESSION)
    bounds = (
        events.join(F.broadcast(aimed), SESSION)
        .where("pmod(xxhash64(part, pos), one_in) = 0")
        .selectExpr(
            *SESSION, "struct(part, pos) AS place", "greatest(1L, aim div one_in) AS every",
            f"row_number() OVER (PARTITION BY {in_order} ORDER BY part, pos) AS nth",
        )
        .where("nth > 1 AND (nth - 1) % every = 0")
        .groupBy(*SESSION)
        .agg(F.array_sort(F.collect_list("place")).alias("bounds"))
    )
    return hot.join(bounds, SESSION, "left")


def split_hot_sessions(
    events: DataFrame,
    hot_after: int | None = None,
    chunk_rows: int | None = None,
    with_start: bool = False,
    sizes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Give events of hot sessions a ``chunk``, a number that rises with the order of events.

    Returns all events, with a NULL chunk for ordinary sessions, and the events of hot sessions
    alone; or the events as they are and None where no session is hot.  ``with_start`` adds
    ``start_ts``, the time of the first event of a hot session.  ``sizes`` are those of
    `session_sizes` where they are known.
    """
    hot_after = HOT_AFTER if hot_after is None else hot_after
    chunk_rows = CHUNK_ROWS if chunk_rows is None else chunk_rows
    if hot_after >= NEVER:
        return events, None
    known = session_sizes(events, hot_after) if sizes is None else sizes
    hot = largest(known.where(F.col("n_rows") > hot_after), SESSION, "n_rows", hot_after)
    if not hot.take(1):
        return events, None
    bounded = _chunk_bounds(events, hot, chunk_rows)
    chunk = f"IF(n_rows IS NULL, NULL, coalesce({number_below('bounds', 'struct(part, pos)')}, 0))"
    kept = [*events.columns, f"{chunk} AS chunk"]
    if with_start:
        # The first event is in the first chunk, so few rows are left to this aggregate.
        first = events.join(F.broadcast(bounded), SESSION).where(
            "bounds IS NULL OR struct(part, pos) < bounds[0]"
        )
        starts = first.groupBy(*SESSION).agg(F.expr("min_by(ts, struct(part, pos)) AS start_ts"))
        bounded = bounded.join(starts, SESSION, "left")
        kept.append("start_ts")
    bounded = F.broadcast(bounded)
    return (
        events.join(bounded, SESSION, "left").selectExpr(*kept),
        events.join(bounded, SESSION).selectExpr(*kept),
    )
