"""The questions of `plans.queries` in SQL, put in another way than the Spark code.

Sequences are found by joining each search with the events that follow it by number, up to the next
search; the Spark code looks back from each event instead.
"""

from __future__ import annotations

ARROW = "' --> '"

EVENTS = """
ev AS (
  SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS unit, user_id AS session_id,
         event_id, ts, event_type, event_type = 'click' AS is_search,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
labelled AS (
  SELECT unit, session_id, event_id, ts, is_search,
         CASE WHEN is_search THEN (CASE WHEN k % 2 = 0 THEN 'Q' ELSE 'q' END) || (k % 3)
              ELSE event_type END AS label
  FROM ev)"""


def placed(source: str = "labelled", name: str = "placed") -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER w AS place,
         CAST(hour(first_value(ts) OVER w) AS INTEGER) AS session_hour,
         lead(CASE WHEN is_search THEN event_id END IGNORE NULLS) OVER w AS next_search
  FROM {source}
  WINDOW w AS (PARTITION BY unit, session_id ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def found(min_seq: int = 2, longest: int = 5, source: str = "labelled") -> str:
    """Searches with their next topics, one row for each number of topics."""
    return f"""{placed(source)},
reach AS (
  SELECT s.unit, s.session_id, s.place, s.session_hour, s.label AS query,
         t.place - s.place AS n_after, t.label
  FROM placed s JOIN placed t
    ON t.unit = s.unit AND t.session_id = s.session_id
   AND t.place > s.place AND t.place < s.place + {longest}
   AND t.place < coalesce(
         (SELECT min(z.place) FROM placed z
          WHERE z.unit = s.unit AND z.session_id = s.session_id AND z.event_id = s.next_search),
         9223372036854775807)
  WHERE s.is_search),
found AS (
  SELECT a.unit, a.session_id, a.place, a.session_hour, a.query,
         list(b.label ORDER BY b.n_after) AS topics, CAST(a.n_after AS INTEGER) AS len
  FROM reach a JOIN reach b
    ON b.unit = a.unit AND b.session_id = a.session_id AND b.place = a.place
   AND b.n_after <= a.n_after
  WHERE a.n_after >= {min_seq} - 1
  GROUP BY a.unit, a.session_id, a.place, a.session_hour, a.query, a.n_after)"""


def counted(support: int = 2, hour: bool = False) -> str:
    key = "session_hour, " if hour else ""
    return f"""
counted AS (
  SELECT unit, {key}query, topics, len, count(*) AS n FROM found
  GROUP BY unit, {key}query, topics, len HAVING count(*) >= {support})"""


def merged(hour: bool = False) -> str:
    key = "session_hour, " if hour else ""
    return f"""
folded AS (
  SELECT {key}lower(query) AS query, list_transform(topics, lambda x: lower(x)) AS topics, len, n
  FROM counted),
merged AS (
  SELECT {key}query, topics, len, CAST(sum(n) AS BIGINT) AS n FROM folded
  GROUP BY {key}query, topics, len)"""


def rolled(hour: bool = False) -> str:
    shown = (
        "string_agg(query || ':' || session_hour || ':' || n, '|' ORDER BY query, session_hour)"
        if hour
        else "string_agg(query || ':' || n, '|' ORDER BY n DESC, query)"
    )
    return f"""
rolled AS (
  SELECT len, topics, CAST(sum(n) AS BIGINT) AS total, {shown} AS queries
  FROM merged WHERE len BETWEEN 2 AND 4 GROUP BY len, topics),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY len ORDER BY total DESC, topics) AS INTEGER)
         AS rank
  FROM rolled QUALIFY rank <= 20),
report AS (
  SELECT r.rank, r.total, m.* FROM ranked r JOIN merged m USING (len, topics))"""


def through(*parts: str, hour: bool = False, support: int = 2) -> str:
    """``WITH`` clause of the whole pipeline."""
    steps = [EVENTS, found(longest=6 if hour else 5), counted(support, hour), merged(hour),
             rolled(hour), *parts]
    return "WITH" + ",".join(steps)


def with_events(*parts: str) -> str:
    return "WITH" + ",".join([EVENTS, *parts])


def topics(column: str = "topics") -> str:
    return f"array_to_string({column}, {ARROW}) AS topics"


LOG = """
log AS (
  SELECT *, event_type AS kind,
         CASE event_type WHEN 'click' THEN 'Search/Lucene' WHEN 'view' THEN 'TopicView/full'
              WHEN 'purchase' THEN 'xTopicView/full/y' WHEN 'signup' THEN 'Search/Lucene/x'
              ELSE 'topicview/full' END AS log_type,
         CASE WHEN event_type = 'click' AND k % 5 = 0 THEN '' ELSE event_type END AS title
  FROM ev WHERE k NOT IN (7, 9)),
kept AS (
  SELECT * FROM log
  WHERE k <> 8 AND kind <> 'error' AND (title <> '' OR k % 10 = 0))"""

NGRAMS = """
wide AS (
  SELECT unit, list((CASE WHEN is_search THEN 's_' ELSE 't_' END) || label) OVER (
           PARTITION BY unit, session_id ORDER BY ts, event_id
           ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead
  FROM labelled),
grams AS (
  SELECT unit, ahead[1:n] AS items
  FROM wide, (SELECT unnest([2, 3, 4, 5]) AS n) WHERE len(ahead) >= n)"""

DAYS = """
days AS (SELECT *, strftime(ts, '%Y%m%d') AS raw_file FROM events),
listed AS (SELECT DISTINCT raw_file, user_id FROM days WHERE event_type = 'purchase'),
kept AS (
  SELECT d.* FROM days d JOIN listed l ON l.raw_file = d.raw_file AND l.user_id = d.user_id)"""

GAPS = """
steps AS (
  SELECT *, ts - lag(ts) OVER (PARTITION BY unit, session_id ORDER BY ts, event_id)
            > INTERVAL 21600 SECOND AS late
  FROM labelled),
gaps AS (
  SELECT * EXCLUDE (late), CAST(sum(CASE WHEN late THEN 1 ELSE 0 END) OVER (
           PARTITION BY unit, session_id ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sub_session
  FROM steps)"""


def text_report(hour: bool = False, tags: bool = False) -> str:
    search, topic = ("s_", "t_") if tags else ("", "")
    line = (
        f"'- {search}' || query || ', ' || session_hour || ', ' || n"
        if hour
        else f"'({search}' || query || ',' || n || ')'"
    )
    shown = f"list_transform(topics, lambda x: '{topic}' || x)"
    return through(hour=hour) + f"""
SELECT len, rank, 1 AS section, '*** [' || total || ']' AS line FROM ranked
UNION ALL
SELECT len, rank, 2, array_to_string({shown}, {ARROW}) || ':' FROM ranked
UNION ALL SELECT len, rank, 3, {line} FROM report
UNION ALL SELECT len, rank, 4, '' FROM ranked"""


def json_report(hour: bool = False) -> str:
    entry, order = (
        ("'{\"query\":\"' || query || '\",\"count\":' || n || ',\"hour\":' || session_hour || '}'",
         "query, session_hour")
        if hour
        else ("'{\"query\":\"' || query || '\",\"count\":' || n || '}'", "n DESC, query")
    )
    return through(hour=hour) + f"""
SELECT len, rank,
       '{{"sequenceCount":' || total || ',"sequence":["' || array_to_string(topics, '","')
       || '"],"searchQueries":[' || string_agg({entry}, ',' ORDER BY {order})
       || '],"part":1,"parts":1}}' AS line
FROM report GROUP BY len, rank, total, topics"""


def oracle_sql() -> dict[str, str]:
    counts = f"SELECT unit, query, {topics()}, n FROM counted"
    hour_counts = f"SELECT unit, session_hour, query, {topics()}, n FROM counted"
    ranked = f"SELECT len, rank, total, {topics()}, 1 AS part, 1 AS parts, queries FROM ranked"
    rollup = f"SELECT len, total, {topics()}, 1 AS part, 1 AS parts, queries FROM rolled"
    # Queries `…_in_parts` cut lists of more than two.
    split = "len(string_split(queries, '|')) > 2 AS split"
    joined = f"SELECT len, rank, total, {topics()}, {split}, queries FROM ranked"
    ordered = "SELECT unit, session_id, place, is_search, label FROM placed"
    ngrams = f"""
SELECT unit, array_to_string(items, {ARROW}) AS items, count(*) AS n
FROM grams GROUP BY unit, grams.items"""
    anchored = f"SELECT unit, session_id, query, {topics()}, len FROM found"
    gaps = "SELECT unit, session_id, event_id, sub_session FROM gaps"
    lines = """
SELECT unit, {0} || '\t' || array_to_string(list_transform(topics, lambda x: 't_' || x), '\t')
       AS value FROM counted"""
    apart = """
apart AS (
  SELECT * REPLACE (CAST(session_id AS VARCHAR) || '#' || sub_session AS session_id) FROM gaps)"""
    short = "format('{}-{}-{} {}:{}:{}', year(ts), month(ts), day(ts), hour(ts), minute(ts), second(ts))"
    full = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
    return {
        "parsed_times": f"""
SELECT event_id,
       CASE event_id % 6 WHEN 0 THEN {full} WHEN 1 THEN {short} WHEN 2 THEN {full} || '.25'
            WHEN 3 THEN {short} || ' CET' WHEN 4 THEN strftime(ts, '%Y-%m-%d') ELSE 'soon' END
         AS written,
       CASE WHEN event_id % 6 < 4 THEN {full} END AS time_text
FROM events""",
        "label_events": with_events() + """
SELECT unit, session_id, event_id, is_search, label,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_text FROM labelled""",
        "parsed_log": with_events(LOG) + """
SELECT unit, CAST(session_id AS VARCHAR) AS session_id,
       row_number() OVER (PARTITION BY unit, session_id ORDER BY ts, event_id) AS place,
       kind = 'click' AS is_search, CASE WHEN kind = 'click' THEN 'q' || (k % 3) ELSE title END AS label
FROM kept""",
        "log_sessions": with_events(LOG) + """
SELECT DISTINCT unit, CAST(session_id AS VARCHAR) AS session_id FROM log""",
        "session_hour": with_events() + """
SELECT unit, session_id, CAST(hour(min(ts)) AS INTEGER) AS session_hour
FROM labelled GROUP BY unit, session_id""",
        "sessions_without_hour": with_events(LOG) + """
SELECT unit, count(*) FILTER (first_kind = 'signup') AS n_sessions
FROM (SELECT unit, arg_min(kind, (ts, event_id)) AS first_kind FROM kept
      GROUP BY unit, session_id)
GROUP BY unit""",
        "session_sequences": with_events(placed()) + ordered,
        "session_sequences_split": with_events(placed()) + ordered,
        "session_ngrams": with_events(NGRAMS) + ngrams,
        "session_ngrams_split": with_events(NGRAMS) + ngrams,
        "session_ngrams_by_hour": through(hour=True, support=1) + hour_counts,
        "anchored_sequences": through() + anchored,
        "anchored_sequences_split": through() + anchored,
        "sequence_counts": through() + counts,
        "sequence_counts_by_hour": through(hour=True) + hour_counts,
        "sequence_counts_by_hour_split": through(hour=True) + hour_counts,
        "merged_counts": through() + f"SELECT query, {topics()}, n FROM merged",
        "merged_counts_by_hour": through(hour=True)
        + f"SELECT session_hour, query, {topics()}, n FROM merged",
        "topic_rollup": through() + rollup,
        "topic_rollup_by_hour": through(hour=True) + rollup,
        "topic_rollup_in_parts": through()
        + f"SELECT len, total, {topics()}, {split}, queries FROM rolled",
        "search_topics": through() + ranked,
        "search_topics_by_hour": through(hour=True) + ranked,
        "search_topics_exact": through(support=1) + ranked,
        "search_topics_split": through() + ranked,
        "search_topics_in_parts": through() + joined,
        "search_topics_by_hour_in_parts": through(hour=True) + joined,
        "search_topics_threshold": "WITH"
        + ",".join([EVENTS, GAPS, apart, found(source="apart"), counted(), merged(), rolled()])
        + ranked,
        "search_topics_rows": through()
        + f"SELECT len, rank, total, {topics()}, query, n FROM report",
        "support_bands": through() + """
SELECT len, count(*) AS n_sequences, count(*) FILTER (total > 100) AS above_100,
       count(*) FILTER (total > 1000) AS above_1000
FROM rolled GROUP BY len""",
        "row_counts": through() + """
SELECT 'rows' AS stage, count(*) AS n FROM events
UNION ALL SELECT 'counted', count(*) FROM counted
UNION ALL SELECT 'len_' || len, count(*) FROM merged WHERE len BETWEEN 2 AND 4 GROUP BY len""",
        "distinct_sessions_by_unit": with_events() + "SELECT DISTINCT unit, session_id FROM ev",
        "distinct_sessions": with_events() + "SELECT DISTINCT session_id FROM ev",
        "distinct_topics": "SELECT DISTINCT event_type AS title FROM events "
        "WHERE event_type <> 'click'",
        "topic_counts": "SELECT event_type AS title, count(*) AS n FROM events "
        "WHERE event_type <> 'click' GROUP BY event_type",
        "listed_sessions_only": f"WITH{DAYS}" + """
SELECT raw_file, user_id AS session_id, event_id, event_type, value FROM kept""",
        "listed_log_lines": f"WITH{DAYS}" + r"""
SELECT raw_file, user_id || chr(9) || event_type || chr(9) || '"' || replace(props, '"', '""')
       || '"' AS value FROM kept""",
        "gap_sessions": with_events(GAPS) + gaps,
        "gap_sessions_split": with_events(GAPS) + gaps,
        "gap_session_sequences": with_events(
            GAPS, apart, found(source="apart"), counted()
        ) + counts,
        "text_report": text_report(),
        "text_report_by_hour": text_report(hour=True),
        "tagged_text_report_by_hour": text_report(hour=True, tags=True),
        "json_report": json_report(),
        "json_report_by_hour": json_report(hour=True),
        "counts_lines": through() + lines.format(r"n || '	s_' || query"),
        "counts_lines_by_hour": through(hour=True)
        + lines.format(r"n || '	h_' || session_hour || '	s_' || query"),
        "counts_from_lines": through() + counts,
        "counts_from_lines_by_hour": through(hour=True) + hour_counts,
    }
