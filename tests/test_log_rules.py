"""Rules of the log format and of the pipeline, each on a small log."""

import pytest
from conftest import HEADER, search, topic

from trailmine import SequenceParams
from trailmine.operators import distinct, events, reports
from trailmine.operators.counts import count_sequences, merge_counts
from trailmine.operators.sequences import anchored_sequences
from trailmine.plans.jobs import count_rows, report_counts
from trailmine.sources import logs


def visit(session, query, *titles):
    return [search(session, query), *[topic(session, title) for title in titles]]


GOLDEN = [
    HEADER,
    *visit("S1", "pulmonary hypertension", "Oph", "Oph1", "Oph2"),
    *visit("S2", "pulmonary hypertension", "Oph", "Oph1", "Oph2"),
]
PARAMS = SequenceParams()


@pytest.fixture
def read(spark, write_log):
    def read(files, **settings):
        return logs.read_log(spark, write_log(files), **settings)

    return read


def counted(rows, params=PARAMS, by_hour=False):
    return {
        (r["unit"], r["query"], *r["topics"]): r["n"]
        for r in count_rows(rows, params, by_hour).collect()
    }


def report(rows, params=PARAMS, by_hour=False):
    result = reports.report_lists(report_counts(count_rows(rows, params, by_hour), params))
    return [
        (r["len"], r["rank"], r["total"], tuple(r["topics"]), [tuple(q) for q in r["queries"]])
        for r in result.orderBy("len", "rank").collect()
    ]


def labels(rows):
    ordered = events.ordered_events(events.label_events(rows)).orderBy("session_id", "place")
    return [(r["session_id"], r["is_search"], r["label"]) for r in ordered.collect()]


def test_golden_case(read):
    rows = read({"20110101.txt": GOLDEN})
    query = "pulmonary hypertension"
    assert counted(rows) == {
        ("201101", query, "Oph", "Oph1", "Oph2"): 2,
        ("201101", query, "Oph", "Oph1"): 2,
        ("201101", query, "Oph"): 2,
    }
    assert report(rows) == [
        (2, 1, 2, ("oph", "oph1"), [(query, 2)]),
        (3, 1, 2, ("oph", "oph1", "oph2"), [(query, 2)]),
    ]


def test_golden_case_by_hour_is_cut(read):
    lines = [
        line.replace(" 09:", " 10:") if line.startswith("S2") else line for line in GOLDEN
    ]
    assert counted(read({"20110101.txt": lines}), by_hour=True) == {}


def test_header_inside_a_file_is_dropped(read):
    rows = read({"20110101.txt": [search("S", "q"), HEADER, topic("S", "a")]})
    assert labels(rows) == [("S", True, "q"), ("S", False, "a")]


def test_empty_fields_at_the_end_do_not_count(read):
    lines = [
        search("S", "dropped", title=""),
        search("S", "dropped too", title="", more="\t\t"),
        search("S", "kept", title="", more="\tz"),
        "\t\t\t",
    ]
    assert labels(read({"20110101.txt": lines})) == [("S", True, "kept")]


def test_event_types(read):
    lines = [
        topic("S", "lower case", kind="topicview/full"),
        topic("S", "contained", kind="xTopicView/full/y"),
        search("S", "q", title="a topic", kind="Search/Lucene/x"),
        search("S", "other", kind="Login"),
    ]
    assert labels(read({"20110101.txt": lines})) == [
        ("S", False, "contained"),
        ("S", False, "a topic"),
    ]


def test_sessions_end_with_the_month_but_not_with_the_day(read):
    first, second = [search("S", "q")], [topic("S", "a"), topic("S", "b")]
    params = SequenceParams(min_unit_support=1)
    apart = read({"20110131.txt": first, "20110201.txt": second})
    assert counted(apart, params) == {}
    together = read({"20110130.txt": first, "20110131.txt": second})
    assert counted(together, params) == {("201101", "q", "a"): 1, ("201101", "q", "a", "b"): 1}


def test_order_of_rows_does_not_matter(spark, read):
    rows = read({"20110101.txt": GOLDEN})
    shuffled = spark.createDataFrame(sorted(rows.collect(), key=hash), rows.schema)
    assert report(shuffled) == report(rows)


def test_blocks_of_a_file_are_read_in_order(spark, read):
    titles = [f"t{i:03}" for i in range(300)]
    lines = [search("S", "q"), *[topic("S", title) for title in titles]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = read({"20110101.txt": lines})
        assert rows.select("part").distinct().count() > 5
        assert [label for _, _, label in labels(rows)] == ["q", *titles]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_window_bounds(read):
    titles = "abcdef"
    rows = read({"20110101.txt": visit("S1", "q", *titles) + visit("S2", "q", *titles)})
    assert max(len(key) - 1 for key in counted(rows)) == 5
    assert max(len(key) - 1 for key in counted(rows, by_hour=True)) == 6
    assert max(len(key) - 1 for key in counted(rows, SequenceParams(window_max=3), True)) == 3
    assert counted(read({"20110201.txt": [search("S9", "q")]})).keys() == counted(rows).keys()


def test_only_one_search_and_in_front(read):
    lines = [
        topic("S", "topic 1"),
        search("S", "search 1"),
        topic("S", "topic 2"),
        search("S", "search 2"),
        topic("S", "topic 3"),
    ]
    found = anchored_sequences(events.label_events(read({"20110101.txt": lines})))
    assert sorted((r["query"], *r["topics"]) for r in found.collect()) == [
        ("search 1", "topic 2"),
        ("search 2", "topic 3"),
    ]


def test_support_is_cut_by_unit(read):
    once = visit("S", "q", "a", "b")
    rows = read({"20110101.txt": once, "20110201.txt": once})
    assert report(rows) == []
    assert report(rows, SequenceParams(min_unit_support=1)) == [
        (2, 1, 2, ("a", "b"), [("q", 2)])
    ]


def test_case_is_folded_after_the_cut(read):
    def spelled(*queries):
        return [line for i, q in enumerate(queries) for line in visit(f"S{i}", q, "A", "B")]

    both = read({"20110101.txt": spelled("Foo", "Foo", "foo", "foo")})
    assert report(both) == [(2, 1, 4, ("a", "b"), [("foo", 4)])]
    assert report(read({"20110101.txt": spelled("Foo", "foo")})) == []


def test_one_topic_is_counted_but_not_reported(read):
    rows = read({"20110101.txt": visit("S1", "q", "a") + visit("S2", "q", "a")})
    assert counted(rows) == {("201101", "q", "a"): 2}
    assert report(rows) == []


@pytest.mark.parametrize(
    ("text", "hour"),
    [
        ("2011-01-01 09:00:00", 9),
        ("2011-01-01 23:59:59.123", 23),
        ("2011-1-1 7:05:09", 7),
        ("2011-1-31 9:05:00x", 9),
        ("2011-1-31 9:05:00xx", 9),
        ("2011-1-31 9:05:00xxx", 9),
        ("2011-01-31T09:05:00", None),
        ("2011-01-31T09:05:00x", None),
        ("yesterday", None),
        ("2011-13-01 09:00:00", None),
    ],
)
def test_reading_of_times(read, text, hour):
    rows = read({"20110101.txt": [search("S", "q", time=text)]})
    [row] = events.session_hour(events.label_events(rows)).collect()
    assert row["hour"] == hour


def test_hour_is_that_of_the_first_kept_event(read):
    def lines(session):
        return [
            search(session, "q", time="2011-01-01 07:59:00", kind="Login"),
            topic(session, "a", time="2011-01-01 09:00:00"),
            search(session, "q", time="2011-01-01 10:00:00"),
            topic(session, "a", time="2011-01-01 10:01:00"),
            topic(session, "b", time="2011-01-01 10:02:00"),
        ]

    rows = read({"20110101.txt": lines("S1") + lines("S2")})
    assert report(rows, by_hour=True) == [(2, 1, 2, ("a", "b"), [("q", 9, 2)])]


def test_sessions_without_hour_are_left_out_and_counted(read):
    bad = [line.replace("2011-01-01 09:0", "?") for line in visit("S3", "q", "a")]
    rows = read(
        {"20110101.txt": visit("S1", "q", "a") + visit("S2", "q", "a") + bad}
    )
    assert counted(rows, by_hour=True) == {("201101", "q", "a"): 2}
    [row] = events.sessions_without_hour(events.label_events(rows)).collect()
    assert (row["unit"], row["n_sessions"]) == ("201101", 1)


def test_order_of_queries(read):
    lines = []
    for query, times in [("b", 2), ("a", 2), ("c", 3)]:
        for i in range(times):
            lines += visit(f"{query}{i}", query, "x", "y")
    rows = read({"20110101.txt": lines})
    [(_, _, total, _, queries)] = report(rows)
    assert (total, queries) == (7, [("c", 3), ("a", 2), ("b", 2)])
    [(_, _, _, _, queries)] = report(rows, by_hour=True)
    assert queries == [("a", 9, 2), ("b", 9, 2), ("c", 9, 3)]


def test_ties_at_the_limit_are_broken_by_the_sequence(read):
    lines = []
    for i, second in enumerate(["c", "a", "d", "b"] * 2):
        lines += visit(f"S{i}", "q", "t", second)
    rows = read({"20110101.txt": lines})
    assert [(r[1], r[3]) for r in report(rows, SequenceParams(results_limit=3))] == [
        (1, ("t", "a")),
        (2, ("t", "b")),
        (3, ("t", "c")),
    ]


def test_distinct_sessions_need_no_full_rows(spark, write_log):
    folder = write_log(
        {"20110101.txt": [HEADER, "S1\tu", "", search("S2", "q"), "S1"], "20110201.txt": ["S1"]}
    )
    sessions = logs.session_ids(logs.read_lines(spark, folder))
    assert {(r["unit"], r["session_id"]) for r in sessions.collect()} == {
        ("201101", "S1"), ("201101", "S2"), ("201102", "S1"),
    }
    by_unit = distinct.distinct_sessions_by_unit(sessions)
    assert by_unit.count() == 3
    assert sorted(r[0] for r in distinct.distinct_sessions(by_unit).collect()) == ["S1", "S2"]


def test_distinct_topics_keep_case(read):
    lines = [topic("S", "A"), topic("S", "a"), topic("S", "A"), search("S", "q", title="no")]
    rows = read({"20110101.txt": lines})
    assert sorted(r[0] for r in distinct.distinct_topics(rows).collect()) == ["A", "a"]
    assert {tuple(r) for r in distinct.topic_counts(rows).collect()} == {("A", 2), ("a", 1)}


def test_only_headers_give_nothing(read):
    rows = read({"20110101.txt": [HEADER], "20110102.txt": [HEADER]})
    assert counted(rows) == {}
    assert report(rows) == []


def test_skipped_units_and_other_files_are_not_read(spark, write_log):
    folder = write_log(
        {"20110101.txt": ["S1"], "20110201.txt": ["S2"], "20110301.csv": ["S3"]}
    )
    lines = logs.read_lines(spark, folder, skip_units=["201101"])
    assert [r["value"] for r in lines.collect()] == ["S2"]


def test_totals_agree_between_stages(read):
    lines = []
    for i in range(12):
        lines += visit(f"S{i}", f"q{i % 3}", *"abcd"[: 2 + i % 3])
    params = SequenceParams(min_unit_support=1)
    merged = merge_counts(count_rows(read({"20110101.txt": lines}), params)).cache()
    totals = {r["len"]: 0 for r in reports.in_report(merged, params).collect()}
    for r in reports.in_report(merged, params).collect():
        totals[r["len"]] += r["n"]
    rolled = dict.fromkeys(totals, 0)
    for r in reports.rollup(merged, params).collect():
        rolled[r["len"]] += r["total"]
        assert r["total"] == sum(q["n"] for q in r["queries"])
    assert rolled == totals
    merged.unpersist()


def test_exact_totals_do_not_depend_on_units(read):
    params = SequenceParams(min_unit_support=1)
    parts = [visit(f"S{i}", "q", "a", "b") for i in range(4)]
    one = read({"20110101.txt": sum(parts, [])})
    assert report(one, params) == [(2, 1, 4, ("a", "b"), [("q", 4)])]
    several = read({f"20120{i + 1}01.txt": part for i, part in enumerate(parts)})
    merged = merge_counts(count_rows(several.where("unit >= '2012'"), params))
    assert {(tuple(r["topics"]), r["n"]) for r in merged.collect()} == {
        (("a",), 4), (("a", "b"), 4),
    }


def test_support_bands_and_row_counts(spark):
    counted_rows = spark.createDataFrame(
        [
            ("u", "q", ["a", "b"], 2, 100), ("u", "r", ["a", "b"], 2, 1),
            ("u", "q", ["a", "c"], 2, 1001), ("u", "q", ["a", "b", "c"], 3, 5),
            ("u", "q", ["a"], 1, 9),
        ],
        "unit string, query string, topics array<string>, len int, n bigint",
    )
    totals = reports.sequence_totals(merge_counts(counted_rows), PARAMS)
    bands = {tuple(r) for r in reports.support_bands(totals).collect()}
    assert bands == {(2, 2, 2, 1), (3, 1, 0, 0)}
    sizes = reports.row_counts(spark.range(7), counted_rows, PARAMS)
    assert {tuple(r) for r in sizes.collect()} == {
        ("rows", 7), ("counted", 5), ("len_2", 3), ("len_3", 1),
    }


def test_events_without_session_take_no_part(spark):
    table = spark.createDataFrame(
        [(None, "Search/Lucene", "q", ""), (None, "TopicView/full", "", "a"),
         ("", "Search/Lucene", "q", ""), ("", "TopicView/full", "", "b")],
        "session_id string, event_type string, query string, title string",
    ).selectExpr(
        "'u' AS unit", "*", "CAST(NULL AS timestamp_ntz) AS ts", "1 AS part",
        "IF(query = 'q', 1, 2) AS pos",
    )
    found = anchored_sequences(events.label_events(table)).collect()
    assert [(r["session_id"], r["topics"]) for r in found] == [("", ["b"])]


def test_rejected_settings():
    for wrong in (
        {"min_seq": 0}, {"max_seq": 2}, {"results_limit": 0}, {"output_type": "XML"},
        {"min_unit_support": 0}, {"window_max": 1},
    ):
        with pytest.raises(ValueError):
            SequenceParams(**wrong)


def test_sequences_are_counted_with_case(read):
    found = anchored_sequences(
        events.label_events(read({"20110101.txt": visit("S1", "Q", "a") + visit("S2", "q", "a")}))
    )
    assert count_sequences(found).count() == 0
    assert count_sequences(found, 1).count() == 2
