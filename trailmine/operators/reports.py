"""Roll-up by topic sequence, ranking, and statistics.

Ranking comes first and needs only totals; lists of queries are made for ranked sequences alone.
The plain form of a report is one row for each query of a sequence, which no hot sequence can make
large.  The nested form puts the queries of a sequence in one list; a list of more than
``LIST_LIMIT`` queries goes on in further rows, its ``parts``, which joined in order of ``part`` are
the one sorted list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from trailmine.operators.hot import MAX_HOT
from trailmine.params import SequenceParams

LIST_LIMIT = 100_000
# Supports counted by `support_bands`.
BANDS = (100, 1000)

SEQUENCE = ["len", "topics"]


def in_report(merged: DataFrame, params: SequenceParams) -> DataFrame:
    """Merged counts of the reported lengths; ``len`` is the number of topics."""
    return merged.where(F.col("len").between(params.min_seq, params.max_seq - 1))


def sequence_totals(merged: DataFrame, params: SequenceParams) -> DataFrame:
    """``len, topics, total, n_queries`` of each topic sequence."""
    return (
        in_report(merged, params)
        .groupBy(*SEQUENCE)
        .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_queries"))
    )


def top_k(totals: DataFrame, k: int) -> DataFrame:
    """The ``k`` sequences of largest total of each length, with their ``rank``."""
    order = Window.partitionBy("len").orderBy(F.desc("total"), "topics")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def observe_totals(
    totals: DataFrame, params: SequenceParams, stats: Observation
) -> DataFrame:
    """Observes, for each length, the entries, the sequences and those above each band."""
    metrics = []
    for n in range(params.min_seq, params.max_seq):
        mine = F.col("len") == n
        metrics += [
            F.coalesce(F.sum(F.when(mine, F.col("n_queries"))), F.lit(0)).alias(f"len_{n}"),
            F.count_if(mine).alias(f"len_{n}_sequences"),
            *[F.count_if(mine & (F.col("total") > b)).alias(f"len_{n}_above_{b}") for b in BANDS],
        ]
    return totals.observe(stats, *metrics)


def report_rows(
    merged: DataFrame, params: SequenceParams, stats: Observation | None = None
) -> DataFrame:
    """The report, one row for each query (and hour) of a ranked sequence.

    ``len, rank, total, n_queries, topics, query, [hour,] n``
    """
    totals = sequence_totals(merged, params)
    if stats is not None:
        totals = observe_totals(totals, params, stats)
    winners = top_k(totals, params.results_limit)
    if params.results_limit * (params.max_seq - params.min_seq) <= MAX_HOT:
        winners = F.broadcast(winners)
    return in_report(merged, params).join(winners, SEQUENCE).select(
        "len", "rank", "total", "n_queries", "topics", "query",
        *(["hour"] if "hour" in merged.columns else []), "n",
    )


def _place(by_hour: bool) -> Column:
    """What a list is sorted by: falling count, then query; with hours query, then hour."""
    return F.struct("query", "hour") if by_hour else F.struct((-F.col("n")).alias("down"), "query")


def _query_list(by_hour: bool) -> Column:
    if by_hour:
        return F.array_sort(F.collect_list(F.struct("query", "hour", "n")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), "query", "n")))
    return F.transform(listed, lambda q: F.struct(q["query"], q["n"]))


def _with_parts(rows: DataFrame, long_lists: DataFrame, list_limit: int) -> DataFrame:
    """Adds ``part`` and ``parts``: ranges of the sorted list, of about ``list_limit`` queries.

    ``long_lists`` are the sequences of more queries, with ``n_queries``.  The ranges come from a
    sample of their queries that a hash decides on, so each run has the same.
    """
    by_hour = "hour" in rows.columns
    place = _place(by_hour)
    names = F.xxhash64("query", "hour") if by_hour else F.xxhash64("query")
    # About twenty sampled queries for each part.
    sampled = F.pmod(names, F.lit(max(1, list_limit // 20))) == 0
    sample = rows.where(sampled).join(long_lists, SEQUENCE).groupBy(*SEQUENCE).agg(
        F.array_sort(F.collect_list(place)).alias("sample")
    )
    parts = f"int(ceil(n_queries / {list_limit}))"
    bounds = long_lists.join(sample, SEQUENCE, "left").selectExpr(
        *SEQUENCE, f"{parts} AS parts",
        f"transform(filter(sequence(1, {parts} - 1), i -> {parts} > 1 AND size(sample) > 0), "
        f"i -> sample[int(i * size(sample) div {parts})]) AS bounds",
    )
    below = F.size(F.filter("bounds", lambda b: b <= place))
    return rows.join(bounds, SEQUENCE, "left").select(
        *[F.col(c) for c in rows.columns],
        F.coalesce(F.greatest(below, F.lit(0)) + 1, F.lit(1)).alias("part"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
    )


def report_lists(rows: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """`report_rows` with the queries of a sequence in one sorted list.

    ``len, rank, total, topics, part, parts, queries``
    """
    long_lists = (
        rows.where(F.col("n_queries") > list_limit).groupBy(*SEQUENCE).agg(
            F.max("n_queries").alias("n_queries"))
    )
    return (
        _with_parts(rows, long_lists, list_limit)
        .groupBy("len", "rank", "total", "topics", "part", "parts")
        .agg(_query_list("hour" in rows.columns).alias("queries"))
        .select("len", "rank", "total", "topics", "part", "parts", "queries")
    )


def rollup(
    merged: DataFrame, params: SequenceParams, list_limit: int = LIST_LIMIT
) -> DataFrame:
    """All topic sequences of the reported lengths with their lists of queries, unranked.

    ``len, topics, total, part, parts, queries``.  The sequences with long lists are found first;
    all others need one aggregate.
    """
    wide = in_report(merged, params)
    long_lists = sequence_totals(merged, params).where(F.col("n_queries") > list_limit)
    listed = (
        _with_parts(wide, long_lists.select(*SEQUENCE, "n_queries"), list_limit)
        .groupBy(*SEQUENCE, "part", "parts")
        .agg(
            F.sum("n").alias("listed"),
            _query_list("hour" in merged.columns).alias("queries"),
        )
    )
    return listed.join(long_lists.select(*SEQUENCE, "total"), SEQUENCE, "left").select(
        *SEQUENCE, F.coalesce("total", "listed").alias("total"), "part", "parts", "queries"
    )


def support_bands(totals: DataFrame) -> DataFrame:
    """Per length the number of sequences, and of those with a total above each band."""
    return totals.groupBy("len").agg(
        F.count(F.lit(1)).alias("n_sequences"),
        *[F.count_if(F.col("total") > band).alias(f"above_{band}") for band in BANDS],
    )


def row_counts(rows: DataFrame, counted: DataFrame, params: SequenceParams) -> DataFrame:
    """Sizes of the stages as ``(stage, n)``: rows read, counted sequences, entries by length."""
    from trailmine.operators.counts import merge_counts

    entries = in_report(merge_counts(counted), params)
    return (
        rows.agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("rows").alias("stage"), "n")
        .unionByName(
            counted.agg(F.count(F.lit(1)).alias("n")).select(F.lit("counted").alias("stage"), "n")
        )
        .unionByName(
            entries.groupBy("len")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.concat(F.lit("len_"), F.col("len").cast("string")).alias("stage"), "n")
        )
    )
