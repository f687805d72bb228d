"""Sequences, places, hours and gaps against brute force, with sessions whole and split."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmine.operators import events, hot, sequences
from trailmine.operators.counts import count_sequences

START = datetime(2024, 3, 1, 5)
BY_TIME = (
    "unit string, session_id bigint, is_search boolean, label string, ts timestamp_ntz, "
    "part timestamp_ntz, pos bigint"
)
BY_BLOCK = BY_TIME.replace(
    "part timestamp_ntz", "part struct<file: string, piece: string, block: bigint>"
)
# Whole; every session split into tiny chunks; only large ones split; one event in a chunk.
SPLITS = [
    {"hot_after": 10**9, "chunk_rows": 1},
    {"hot_after": 0, "chunk_rows": 3},
    {"hot_after": 12, "chunk_rows": 5},
    {"hot_after": 1, "chunk_rows": 1},
]


def make_sessions(seed):
    """Sessions of very different sizes; times come in bursts, with ties and long breaks."""
    rng = random.Random(seed)
    sessions = {}
    for unit in ("u1", "u2"):
        for session, size in enumerate([1, 2, 3, 5, 8, 13, 30, 90]):
            at, session_events = START + timedelta(minutes=rng.randrange(600)), []
            for _ in range(size):
                at += timedelta(seconds=rng.choice([0, 0, 1, 30, 599, 600, 601, 5000]))
                session_events.append((rng.random() < 0.3, f"l{rng.randrange(4)}", at))
            sessions[unit, session] = session_events
    return sessions


def as_table(spark, sessions, by_block, seed=0):
    rows = []
    for (unit, session), session_events in sessions.items():
        block = 0
        for pos, (is_search, label, at) in enumerate(session_events):
            block += random.Random(pos + session).random() < 0.2
            part = (f"2024030{block // 10}.txt", "", block % 10) if by_block else at
            # In a file the order of lines counts, and the number may start anywhere in a block.
            rows.append((unit, session, is_search, label, at, part, pos))
    random.Random(seed).shuffle(rows)
    schema = BY_BLOCK if by_block else BY_TIME
    return spark.createDataFrame(rows, schema).repartition(3)


def runs(sessions, low, high):
    for (unit, session), session_events in sessions.items():
        for size in range(low, high + 1):
            for i in range(len(session_events) - size + 1):
                yield unit, session, session_events[i : i + size], session_events[0][2].hour


def valid(run):
    return run[0][0] and not any(is_search for is_search, _, _ in run[1:])


@pytest.fixture(params=[False, True], ids=["times", "blocks"])
def data(request, spark):
    sessions = make_sessions(7)
    table = as_table(spark, sessions, request.param).cache()
    yield sessions, table
    table.unpersist()


@pytest.mark.parametrize("split", SPLITS, ids=str)
def test_sequences(data, split):
    sessions, table = data
    low, high = 2, 5
    found = sequences.anchored_sequences(table, low, high, by_hour=True, **split).collect()
    assert Counter(
        (r["unit"], r["session_id"], r["hour"], r["query"], *r["topics"]) for r in found
    ) == Counter(
        (unit, session, hour, *[label for _, label, _ in run])
        for unit, session, run, hour in runs(sessions, low, high)
        if valid(run)
    )
    assert all(r["len"] == len(r["topics"]) for r in found)


@pytest.mark.parametrize("split", SPLITS, ids=str)
def test_ngrams(data, split):
    sessions, table = data
    low, high = 1, 4
    found = sequences.session_ngrams(table, low, high, by_hour=True, **split)
    assert Counter(
        (r["unit"], r["session_id"], r["hour"], *[tuple(i) for i in r["items"]])
        for r in found.collect()
    ) == Counter(
        (unit, session, hour, *[(is_search, label) for is_search, label, _ in run])
        for unit, session, run, hour in runs(sessions, low, high)
    )


@pytest.mark.parametrize("split", SPLITS, ids=str)
def test_places_and_gaps(data, split):
    sessions, table = data
    places, subs = {}, {}
    for key, session_events in sessions.items():
        sub = 0
        for i, (_, _, at) in enumerate(session_events):
            sub += i > 0 and (at - session_events[i - 1][2]).total_seconds() > 600
            places[(*key, i)], subs[(*key, i)] = i + 1, sub

    def by_event(df, column):
        return {(r["unit"], r["session_id"], r["pos"]): r[column] for r in df.collect()}

    assert by_event(events.ordered_events(table, **split), "place") == places
    gaps = events.split_sessions_by_gap(table, 600, **split)
    assert by_event(gaps, "sub_session") == subs
    apart = events.as_sessions(gaps)
    assert apart.select("unit", "session_id").distinct().count() == len(
        {(unit, session, sub) for (unit, session, _), sub in subs.items()}
    )


def test_windows_and_look_back_agree(data):
    _, table = data
    for low, high in ((1, 1), (1, 3), (2, 6)):
        anchored = count_sequences(sequences.anchored_sequences(table, low, high), 1)
        windows = sequences.valid_ngrams(sequences.session_ngrams(table, low, high), high)
        counted = count_sequences(windows, 1)
        assert anchored.count() > 0
        assert anchored.exceptAll(counted).count() == counted.exceptAll(anchored).count() == 0


def test_gap_at_the_threshold_is_no_break(spark):
    times = [0, 600, 1201]
    sessions = {("u", 1): [(False, "a", START + timedelta(seconds=s)) for s in times]}
    gaps = events.split_sessions_by_gap(as_table(spark, sessions, False), 600)
    assert [r["sub_session"] for r in gaps.orderBy("pos").collect()] == [0, 0, 1]


def test_events_without_time_start_no_session(spark):
    at = START + timedelta(days=1)
    sessions = {("u", 1): [(False, "a", START), (False, "b", None), (False, "c", at)]}
    gaps = events.split_sessions_by_gap(as_table(spark, sessions, True), 600)
    assert [r["sub_session"] for r in gaps.orderBy("pos").collect()] == [0, 0, 0]


def test_events_without_place_come_first(spark):
    times = [None, None, START, START + timedelta(hours=1), None, START + timedelta(hours=2)]
    labels = [(True, "q"), (False, "a"), (False, "c"), (False, "d"), (False, "b"), (False, "e")]
    sessions = {("u", 1): [(*label, at) for label, at in zip(labels, times)]}
    table = as_table(spark, sessions, False)
    for split in SPLITS:
        found = sequences.anchored_sequences(table, 2, 6, **split)
        assert sorted("".join(r["topics"]) for r in found.collect()) == [
            "a", "ab", "abc", "abcd", "abcde",
        ]


def test_chunks_follow_the_order_and_stay_small(spark):
    table = spark.range(100_000).selectExpr(
        "'u' AS unit", "id % 3 DIV 2 AS session_id", "true AS is_search", "'q' AS label",
        "CAST(NULL AS timestamp_ntz) AS ts", "id * 1000 AS part", "id AS pos",
    )
    spread, alone = hot.split_hot_sessions(table, hot_after=50_000, chunk_rows=1_000)
    assert spread.count() == 100_000
    sizes = alone.groupBy("session_id", "chunk").count().collect()
    assert {r["session_id"] for r in sizes} == {0}
    assert 60 <= len(sizes) <= 70 and max(r["count"] for r in sizes) <= 1_100
    from pyspark.sql import functions as F

    bounds = alone.groupBy("chunk").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    ordered = bounds.orderBy("chunk").collect()
    assert all(x["b"] < y["a"] for x, y in zip(ordered, ordered[1:]))


def test_the_list_of_hot_keys_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(hot, "MAX_HOT", 2)
    sessions = make_sessions(3)
    table = as_table(spark, sessions, False)
    listed = hot.hot_keys(table, hot.SESSION, 5).collect()
    assert [(r["unit"], r["session_id"], r["n_rows"]) for r in listed] == [
        ("u1", 7, 90), ("u2", 7, 90),
    ]
    found = sequences.anchored_sequences(table, hot_after=5, chunk_rows=3)
    whole = sequences.anchored_sequences(table)
    assert found.exceptAll(whole).count() == whole.exceptAll(found).count() == 0


def test_numbers_and_instants_order_sessions_too(spark):
    table = as_table(spark, make_sessions(5), False)
    seconds = table.selectExpr("* EXCEPT (part)", "unix_date(CAST(part AS date)) * 86400L + "
                               "hour(part) * 3600 + minute(part) * 60 + second(part) AS part")
    instants = table.selectExpr("* EXCEPT (part)", "CAST(part AS timestamp) AS part")
    expected = sequences.anchored_sequences(table, by_hour=True)
    for other in (seconds, instants):
        found = sequences.anchored_sequences(other, by_hour=True, hot_after=5, chunk_rows=3)
        assert found.exceptAll(expected).count() == expected.exceptAll(found).count() == 0


@pytest.mark.parametrize("burst", ["one instant", "two bursts", "first and last"])
def test_bursts_are_cut_like_other_events(spark, burst):
    """Chunks follow the number of events, not the time they take."""
    second = {"one instant": "0", "two bursts": "IF(id < 15000, id % 3, 86400 + id % 2)",
              "first and last": "IF(id = 0, -999999, IF(id = 19999, 999999, 5))"}[burst]
    table = spark.range(20_000).selectExpr(
        "'u' AS unit", "7L AS session_id", "id % 3 = 0 AS is_search", "'x' AS label",
        f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {second}) AS ts",
    ).selectExpr("*", "ts AS part", "monotonically_increasing_id() AS pos")
    table = table.repartition(4)
    _, alone = hot.split_hot_sessions(table, hot_after=5_000, chunk_rows=1_000)
    chunks = alone.groupBy("chunk").agg(
        F.count("*").alias("n"), F.min(F.struct("part", "pos")).alias("low"),
        F.max(F.struct("part", "pos")).alias("high"),
    ).orderBy("chunk").collect()
    assert sum(r["n"] for r in chunks) == 20_000
    assert 15 <= len(chunks) <= 25 and max(r["n"] for r in chunks) <= 2_000
    assert all(a["high"] < b["low"] for a, b in zip(chunks, chunks[1:]))


def test_chunks_from_a_sample_stay_within_twice_the_aim(spark, monkeypatch):
    monkeypatch.setattr(hot, "CHUNK_SAMPLE", 32)
    table = spark.range(200_000).selectExpr(
        "'u' AS unit", "id % 2 AS session_id", "true AS is_search", "'x' AS label",
        "timestamp_ntz'2024-01-01 00:00:00' AS ts", "timestamp_ntz'2024-01-01 00:00:00' AS part",
        "id AS pos")
    _, alone = hot.split_hot_sessions(table, hot_after=5_000, chunk_rows=1_000)
    sizes = [r["count"] for r in alone.groupBy("session_id", "chunk").count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) <= 2_000 and len(sizes) >= 150


def test_no_pieces_in_the_plan_without_hot_sessions(spark):
    table = as_table(spark, make_sessions(1), by_block=False)
    plan = sequences.session_ngrams(table, 2, 4)._jdf.queryExecution().toString()
    assert "Join" not in plan
    hour = events.session_hour(table)._jdf.queryExecution().toString()
    assert "HashAggregate" in hour and "SortAggregate" not in hour
