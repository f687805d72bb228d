"""Jobs, files and formats."""

import json
import os
from pathlib import Path

import pytest
from conftest import HEADER, search, topic

from trailmine import JOBS, Job, SequenceParams, run
from trailmine.functions.formats import JSON_FIELDS, counts_lines
from trailmine.operators import reports
from trailmine.operators.counts import merge_counts
from trailmine.operators.events import label_events, ordered_events
from trailmine.plans import jobs
from trailmine.sinks.counts import export_counts_tsv, stored_units
from trailmine.sinks.reports import write_json_report, write_text_report
from trailmine.sources import logs
from trailmine.sources.counts import parse_counts, read_counts, read_counts_tsv


def visit(session, query, *titles):
    return [search(session, query), *[topic(session, title) for title in titles]]


LOG = {
    "20110101.txt": [HEADER, *visit("S1", "q", "A", "B"), *visit("S2", "q", "A", "B")],
    "20110102.txt": [HEADER, *visit("S3", "Q", "a", "b", "c"), *visit("S4", "Q", "a", "b", "c")],
    "20110201.txt": [HEADER, *visit("S5", "r", "A", "B"), *visit("S6", "r", "A", "B"), "short"],
}


@pytest.fixture
def params(tmp_path, write_log):
    def make(action="SearchTopics", **settings):
        return SequenceParams(
            action=action,
            raw_folder=write_log(LOG),
            results_folder=str(tmp_path / "results"),
            **settings,
        )

    return make


def lines_of(folder):
    files = sorted(Path(folder).glob("part-*"))
    return [line for file in files for line in file.read_text().split("\n")[:-1]]


def text_files(folder):
    return sorted(p.name for p in Path(folder).rglob("part-*"))


def test_search_topics_json(spark, params):
    settings = params()
    run(spark, settings, single_file=True)
    folder = f"{settings.job_folder}/processed"
    [two] = lines_of(f"{folder}/len=2")
    assert json.loads(two) == {
        "sequenceCount": 6,
        "sequence": ["a", "b"],
        "searchQueries": [{"query": "q", "count": 4}, {"query": "r", "count": 2}],
        "part": 1,
        "parts": 1,
    }
    [three] = lines_of(f"{folder}/len=3")
    assert json.loads(three)["sequence"] == ["a", "b", "c"]
    assert not os.path.exists(f"{folder}/len=4")
    counted = read_counts(spark, f"{settings.job_folder}/preprocessed")
    assert {r["unit"] for r in counted.collect()} == {"201101", "201102"}


def test_search_topics_text(spark, params):
    settings = params(output_type="TEXT")
    run(spark, settings)
    assert lines_of(f"{settings.job_folder}/processed/len=2") == [
        "*** [6]", "a --> b:", "(q,4)", "(r,2)", "",
    ]


def test_by_hour(spark, params):
    for output_type in ("TEXT", "JSON"):
        settings = params("SearchTopicsByHour", output_type=output_type)
        run(spark, settings, keep_existing=False)
        lines = lines_of(f"{settings.job_folder}/processed/len=2")
        if output_type == "TEXT":
            assert lines == ["*** [6]", "a --> b:", "- q, 9, 4", "- r, 9, 2", ""]
        else:
            assert json.loads(lines[0])["searchQueries"] == [
                {"query": "q", "count": 4, "hour": 9}, {"query": "r", "count": 2, "hour": 9},
            ]


def test_distinct_session(spark, params):
    settings = params("DistinctSession")
    run(spark, settings, single_file=True)
    folder = f"{settings.job_folder}/processed"
    assert sorted(lines_of(folder)) == ["S1", "S2", "S3", "S4", "S5", "S6", "short"]
    assert len(text_files(folder)) == 1


def test_distinct_topics(spark, params):
    settings = params("DistinctTopics")
    run(spark, settings)
    found = lines_of(f"{settings.job_folder}/processed")
    assert len(found) == len(set(found)) and {"A", "B", "a", "b", "c"} <= set(found)


def test_tags_are_kept_through_a_job(spark, params):
    from dataclasses import replace

    settings = replace(params(), output_type="TEXT", keep_tags=True, min_unit_support=1)
    run(spark, settings)
    lines = lines_of(f"{settings.job_folder}/processed/len=2")
    assert any(line.startswith("t_") for line in lines)
    assert any(line.startswith("(s_") for line in lines)


def test_unknown_action(spark, params):
    with pytest.raises(ValueError, match="unknown action 'Nothing'"):
        run(spark, params("Nothing"))


def test_own_job(spark, params):
    titles = Job(
        lambda rows, settings: rows.select("unit", "title").distinct(),
        lambda stored, settings: stored.select("title").distinct(),
        JOBS["DistinctSession"].write,
        "unit string, title string",
    )
    settings = params("Titles")
    run(spark, settings, jobs={**JOBS, "Titles": titles})
    assert sorted(lines_of(f"{settings.job_folder}/processed")) == sorted("xABabc")


def test_results_are_kept_and_new_units_added(spark, params, write_log):
    settings = params()
    folder = f"{settings.job_folder}/preprocessed"
    assert stored_units(spark, folder) == []
    run(spark, settings)
    before = text_files(folder)
    jobs.preprocess(spark, settings)
    assert text_files(folder) == before
    write_log({"20110301.txt": visit("S7", "s", "A", "B") + visit("S8", "s", "A", "B")})
    run(spark, settings)
    assert stored_units(spark, folder) == ["201101", "201102", "201103"]
    assert set(before) < set(text_files(folder))
    assert '"sequenceCount":6' in lines_of(f"{settings.job_folder}/processed/len=2")[0]
    run(spark, settings, keep_existing=False)
    assert '"sequenceCount":8' in lines_of(f"{settings.job_folder}/processed/len=2")[0]


def test_rows_are_parsed_once_for_all_jobs(spark, params, tmp_path):
    rows_folder = str(tmp_path / "rows")
    plain, by_hour = params(), params("SearchTopicsByHour")
    run(spark, plain, rows_folder=rows_folder)
    stored = text_files(rows_folder)
    run(spark, by_hour, rows_folder=rows_folder)
    assert text_files(rows_folder) == stored
    assert '"sequenceCount":6' in lines_of(f"{plain.job_folder}/processed/len=2")[0]
    assert '"sequenceCount":6' in lines_of(f"{by_hour.job_folder}/processed/len=2")[0]
    parsed = logs.read_log(spark, plain.raw_folder)
    kept = logs.read_stored_rows(spark, rows_folder)
    # Places are numbers in stored rows; within a unit they give the same order.
    place = [c for c in parsed.columns if c != "part"]
    assert kept.select(place).exceptAll(parsed.select(place)).count() == 0
    assert parsed.count() == kept.count()

    def in_order(rows):
        return [tuple(r) for r in rows.orderBy("unit", "part", "pos").select(place).collect()]

    assert in_order(kept) == in_order(parsed)


def test_empty_log(spark, params, write_log):
    settings = params()
    raw = write_log({"20110101.txt": [HEADER]}, "empty")
    for action in JOBS:
        nothing = SequenceParams(
            action=action, raw_folder=raw, results_folder=settings.results_folder
        )
        run(spark, nothing)
        assert text_files(f"{nothing.job_folder}/processed/len=2") == []


@pytest.fixture
def counted(spark):
    return spark.createDataFrame(
        [
            ("201101", 9, "Q one", ["A", "B b"], 2, 3),
            ("201101", 10, "Q one", ["A", "B b"], 2, 2),
            ("201102", 0, 'say "x"', ['T "1"', "b", "c"], 3, 7),
        ],
        "unit string, hour int, query string, topics array<string>, len int, n bigint",
    )


def test_counts_as_tab_separated_text(spark, counted, tmp_path):
    plain = counted.drop("hour")
    assert {r["value"] for r in counts_lines(plain).collect()} == {
        "3\ts_Q one\tt_A\tt_B b", "2\ts_Q one\tt_A\tt_B b", '7\ts_say "x"\tt_T "1"\tt_b\tt_c',
    }
    assert "3\th_9\ts_Q one\tt_A\tt_B b" in {r["value"] for r in counts_lines(counted).collect()}
    for df, by_hour in ((plain, False), (counted, True)):
        for single_file in (False, True):
            folder = str(tmp_path / f"tsv-{by_hour}-{single_file}")
            export_counts_tsv(df, folder, single_file)
            back = read_counts_tsv(spark, folder, by_hour).select(*df.columns)
            assert back.collect() and back.exceptAll(df).count() == 0
            assert back.count() == df.count()


def test_counts_text_without_units(spark):
    lines = spark.createDataFrame([("4\ts_Q\tt_A",)], "value string")
    [row] = merge_counts(parse_counts(lines)).collect()
    assert (row["query"], row["topics"], row["len"], row["n"]) == ("q", ["a"], 1, 4)


@pytest.fixture
def rows(counted):
    return reports.report_rows(merge_counts(counted.drop("hour")), SequenceParams())


def test_json_escapes_quotes(rows, tmp_path):
    folder = str(tmp_path / "json")
    write_json_report(rows, folder)
    [line] = lines_of(f"{folder}/len=3")
    assert json.loads(line) == {
        "sequenceCount": 7,
        "sequence": ['t "1"', "b", "c"],
        "searchQueries": [{"query": 'say "x"', "count": 7}],
    }


def test_text_with_tags(counted, tmp_path):
    by_hour = reports.report_rows(merge_counts(counted), SequenceParams())
    folder = str(tmp_path / "tagged")
    write_text_report(by_hour, folder, keep_tags=True)
    assert lines_of(f"{folder}/len=2") == [
        "*** [5]", "t_a --> t_b b:", "- s_q one, 9, 3", "- s_q one, 10, 2", "",
    ]


def test_text_reports_keep_their_order_over_files(spark, tmp_path):
    wide = spark.range(400).selectExpr(
        "concat('q', lpad(id, 3, '0')) AS query", "array(concat('t', id % 7), 'x') AS topics",
        "2 AS len", "1 + id % 3 AS n",
    )
    report = reports.report_rows(wide, SequenceParams())
    several, one = str(tmp_path / "several"), str(tmp_path / "one")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_text_report(report, several)
        write_text_report(report, one, single_file=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(text_files(several)) > 1
    assert len(text_files(one)) == 1
    lines = lines_of(f"{one}/len=2")
    assert lines == lines_of(f"{several}/len=2")
    assert len(lines) == 400 + 3 * 7
    blocks = "\n".join(lines).split("\n\n")
    totals = [int(block.split("[")[1].split("]")[0]) for block in blocks if block]
    assert totals == sorted(totals, reverse=True)


@pytest.mark.parametrize("limit", [1, 4, 11, 12, 13])
def test_parts_joined_in_order_are_the_sorted_list(spark, limit):
    counts = [5, 9, 1, 5, 12, 7, 7, 3, 2, 11, 10, 4]
    for by_hour in (False, True):
        rows = [(2, ["a", "b"], f"q{i}", n, *([i % 3] if by_hour else []))
                for i, n in enumerate(counts)]
        merged = spark.createDataFrame(
            rows, "len int, topics array<string>, query string, n long" + ", hour int" * by_hour)
        report = reports.report_rows(merged, SequenceParams())
        for lists in (reports.report_lists(report, limit),
                      reports.rollup(merged, SequenceParams(), limit)):
            found = sorted(lists.collect(), key=lambda r: r["part"])
            joined = [q["query"] for r in found for q in r["queries"]]
            order = (lambda r: r[2]) if by_hour else (lambda r: (-r[3], r[2]))
            assert joined == [r[2] for r in sorted(rows, key=order)]
            assert {r["parts"] for r in found} == {-(-12 // limit)}
            assert {r["total"] for r in found} == {sum(counts)}


def test_long_lists_are_split_and_whole(spark, tmp_path):
    merged = spark.range(1000).selectExpr(
        "concat('q', id) AS query", "IF(id < 900, array('a', 'b'), array('c', 'd')) AS topics",
        "2 AS len", "id + 1 AS n",
    )
    report = reports.report_rows(merged, SequenceParams())
    for lists in (
        reports.report_lists(report, list_limit=100),
        reports.rollup(merged, SequenceParams(), list_limit=100),
    ):
        found = lists.collect()
        parts = [r for r in found if r["topics"] == ["a", "b"]]
        assert len(parts) > 5 and {r["parts"] for r in parts} == {9}
        assert {r["total"] for r in parts} == {sum(range(1, 901))}
        assert sorted(q["n"] for r in parts for q in r["queries"]) == list(range(1, 901))
        [whole] = [r for r in found if r["topics"] == ["c", "d"]]
        assert (whole["part"], whole["parts"], len(whole["queries"])) == (1, 1, 100)
        for r in found:
            counts = [q["n"] for q in r["queries"]]
            assert counts == sorted(counts, reverse=True)
        parts.sort(key=lambda r: r["part"])
        assert [q["n"] for r in parts for q in r["queries"]] == list(range(900, 0, -1))
        assert max(len(r["queries"]) for r in parts) <= 200
    folder = str(tmp_path / "json")
    write_json_report(report, folder, list_limit=100)
    objects = [json.loads(line) for line in lines_of(f"{folder}/len=2")]
    [short] = [o for o in objects if o["sequence"] == ["c", "d"]]
    assert (short["part"], short["parts"]) == (1, 1)
    assert all(list(o) == JSON_FIELDS for o in objects)
    assert sum(len(o["searchQueries"]) for o in objects) == 1000


@pytest.fixture
def listed_log(write_log, tmp_path):
    raw = write_log(
        {
            "20110101.txt": [
                HEADER, *visit("S1", '"quoted phrase"', "A", 'B "b"', "C"), "S1", *visit("S2", "q"),
            ],
            "20110102.txt": visit("S1", "q", "A"),
            "20110103.txt": visit("S1", "q", "A"),
        }
    )
    lists = write_log(
        {"2011/c20110101.txt": ["S1\t1", "S1\t2"], "2012/c20110103.txt": ["S9"]}, "lists"
    )
    return raw, lists, str(tmp_path / "filtered")


def test_listed_sessions_only(spark, listed_log):
    raw, lists, output = listed_log
    jobs.filter_log(spark, lists, raw, output)
    assert lines_of(f"{output}/raw_file=20110101.txt") == [
        "S1\tu\tip\tSearch/Lucene\t2011-01-01 09:00:00\tquoted phrase\tx",
        topic("S1", "A"),
        'S1\tu\tip\tTopicView/full\t2011-01-01 09:01:00\t\t"B ""b"""',
        topic("S1", "C"),
        "S1",
    ]
    assert [p.name for p in Path(output).glob("raw_file=*")] == ["raw_file=20110101.txt"]
    again = label_events(logs.read_log(spark, output))
    ordered = ordered_events(again).orderBy("place").collect()
    assert {r["unit"] for r in ordered} == {"201101"}
    assert [r["label"] for r in ordered] == ["quoted phrase", "A", '"B ""b"""', "C"]


def test_filtered_log_keeps_order_over_blocks(spark, write_log, tmp_path):
    titles = [f"t{i:03}" for i in range(300)]
    raw = write_log({"20110101.txt": [topic("S", title) for title in titles]})
    lists = write_log({"2011/c20110101.txt": ["S"]}, "lists")
    output = str(tmp_path / "filtered")
    for key, value in (
        ("spark.sql.files.maxPartitionBytes", "1000"),
        ("spark.sql.adaptive.coalescePartitions.enabled", "false"),
    ):
        spark.conf.set(key, value)
    try:
        jobs.filter_log(spark, lists, raw, output, years=["2011"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(text_files(output)) > 1
    ordered = ordered_events(label_events(logs.read_log(spark, output))).orderBy("place")
    assert [r["label"] for r in ordered.collect()] == titles


def statistics(settings, phase):
    found = [json.loads(line) for line in lines_of(f"{settings.job_folder}/statistics/phase={phase}")]
    return {r["stage"]: r["n"] for r in found}


def test_numbers_of_a_run_are_written(spark, params):
    settings = params()
    run(spark, settings)
    stored = read_counts(spark, f"{settings.job_folder}/preprocessed")
    # The log has 6 searches, 14 topic views, three headers and a short line.
    assert statistics(settings, "preprocess") == {
        "rows": 20, "sessions": 6, "sessions_without_hour": 0, "counted": stored.count()}
    merged = merge_counts(stored)
    want = {"len_2": merged.where("len = 2").count(), "len_3": merged.where("len = 3").count()}
    numbers = statistics(settings, "process")
    assert {k: v for k, v in numbers.items() if k in want} == want
    assert numbers["len_2_sequences"] == 1 and numbers["len_2_above_100"] == 0
    assert set(numbers) >= {"len_4", "len_4_sequences", "len_4_above_1000"}


def test_sessions_without_hour_are_counted_in_a_run(spark, write_log, tmp_path):
    def at(session, time):
        return [search(session, "q", time), topic(session, "A", time), topic(session, "B", time)]

    raw = write_log({"20110101.txt": at("S1", "2011-01-01 09:00:00") + at("S2", "soon")}, "odd")
    settings = SequenceParams("SearchTopicsByHour", raw_folder=raw, min_unit_support=1,
                              results_folder=str(tmp_path / "odd-results"))
    run(spark, settings)
    found = statistics(settings, "preprocess")
    assert (found["sessions"], found["sessions_without_hour"]) == (2, 1)


def test_sessions_split_by_a_threshold(spark, write_log, tmp_path):
    """A search and the topics an hour later are one session, or two."""
    raw = write_log({"20110101.txt": [
        search("S", "q", "2011-01-01 09:00:00"), topic("S", "A", "2011-01-01 09:10:00"),
        topic("S", "B", "2011-01-01 10:10:01"), topic("S", "C", "2011-01-01 10:20:00"),
        search("S", "r", "2011-01-01 10:21:00"), topic("S", "D", "2011-01-01 10:22:00"),
        topic("S", "E", "2011-01-01 10:23:00")]}, "gaps")
    sequences = {}
    for action in ("SearchTopics", "SearchTopicsByHour"):
        for threshold in (None, 3600, 3601):
            settings = SequenceParams(
                action, min_seq=1, max_seq=4, raw_folder=raw, min_unit_support=1,
                session_threshold=threshold, results_folder=str(tmp_path / f"gap-{threshold}"))
            run(spark, settings)
            stored = spark.read.parquet(f"{settings.job_folder}/preprocessed")
            sequences[action, threshold] = sorted(
                (r["query"], "".join(r["topics"])) for r in stored.collect())
        assert ("q", "ABC") in sequences[action, None] == sequences[action, 3601]
        assert ("q", "AB") not in sequences[action, 3600]
        assert ("r", "DE") in sequences[action, 3600]
    with pytest.raises(ValueError, match="session_threshold"):
        SequenceParams(session_threshold=0)


def test_threshold_gives_the_same_for_hot_sessions(spark, params, monkeypatch, tmp_path):
    titles = [topic("S", f"t{i % 5}", f"2011-01-01 {i // 60:02}:{i % 60:02}:00") for i in range(200)]
    searches = [search("S", "q", "2011-01-01 01:00:00")] + titles[:3]
    raw = str(tmp_path / "hot-raw")
    Path(raw).mkdir()
    Path(f"{raw}/20110101.txt").write_text("\n".join(searches + titles[70:90] + searches))
    found = []
    for hot_after in (jobs.hot.HOT_AFTER, 5):
        monkeypatch.setattr(jobs.hot, "HOT_AFTER", hot_after)
        monkeypatch.setattr(jobs.hot, "CHUNK_ROWS", 4)
        settings = params(session_threshold=60, min_unit_support=1)
        settings = SequenceParams(**{**settings.__dict__, "raw_folder": raw})
        log = logs.read_log(spark, raw)
        found.append(sorted(map(repr, jobs.count_rows(log, settings).collect())))
    assert found[0] == found[1] and found[0]


def test_units_without_rows_are_done(spark, params, write_log, monkeypatch):
    settings = params()
    write_log({"20110401.txt": [HEADER]})
    run(spark, settings)
    folder = f"{settings.job_folder}/preprocessed"
    assert stored_units(spark, folder) == ["201101", "201102", "201104"]
    # A second run does not come as far as to count.
    monkeypatch.setattr(jobs, "write_by_unit", None)
    jobs.preprocess(spark, settings)


def test_rows_are_stored_without_exchange(spark, params, tmp_path, monkeypatch):
    settings, plans = params(), []
    real = jobs.store_rows

    def keep(rows, folder):
        plans.append(rows._jdf.queryExecution().toString())
        real(rows, folder)

    monkeypatch.setattr(jobs, "store_rows", keep)
    folder = str(tmp_path / "rows")
    jobs.store_log(spark, settings.raw_folder, folder)
    assert plans and "Exchange hash" not in plans[0] and "Exchange range" not in plans[0]
    assert stored_units(spark, folder) == ["201101", "201102"]
    jobs.store_log(spark, settings.raw_folder, folder)
    assert len(plans) == 1
    monkeypatch.setattr(jobs, "SIZES_ABOVE", 1)
    again = str(tmp_path / "sized")
    jobs.store_log(spark, settings.raw_folder, again)
    sizes = logs.read_session_sizes(spark, again)
    assert sorted(r["n_rows"] for r in sizes.collect()) == [3, 3, 3, 3, 4, 4]


def test_stored_sizes_spare_the_count(spark, params, tmp_path):
    settings = params()
    folder = str(tmp_path / "rows")
    jobs.store_log(spark, settings.raw_folder, folder)
    rows = logs.read_stored_rows(spark, folder)
    plan = jobs.count_rows(rows, settings, sizes=logs.read_session_sizes(spark, folder))
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_filtered_log_is_written_as_scanned(spark, write_log, tmp_path, monkeypatch):
    raw = write_log({"20110101.txt": [topic("S", f"t{i}") for i in range(20)], "20110103.txt": ["S"]})
    lists = write_log({"2011/c20110101.txt": ["S"], "2011/c20110102.txt": ["S"]}, "lists")
    plans, real, contents = [], jobs.write_filtered_log, []

    def keep(lines, folder, as_scanned):
        plans.append((as_scanned, lines._jdf.queryExecution().toString()))
        real(lines, folder, as_scanned=as_scanned)

    monkeypatch.setattr(jobs, "write_filtered_log", keep)
    for limit in (jobs.MAX_LISTED, 0):
        monkeypatch.setattr(jobs, "MAX_LISTED", limit)
        output = str(tmp_path / f"filtered-{limit}")
        jobs.filter_log(spark, lists, raw, output, years=["2011"])
        contents.append(lines_of(f"{output}/raw_file=20110101.txt"))
        assert [p.name for p in Path(output).glob("raw_file=*")] == ["raw_file=20110101.txt"]
    assert contents[0] == contents[1] == [topic("S", f"t{i}") for i in range(20)]
    assert plans[0][0] and "Exchange range" not in plans[0][1] and "Exchange hash" not in plans[0][1]
