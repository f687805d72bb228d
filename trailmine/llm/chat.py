"""Tool calls of conversations: linked to their results, ordered, validated, as canonical JSON.

Calls and results are tables joined by conversation and call identifier.  A call whose arguments
name other calls of the conversation (``{"$call": id}``) depends on them; calls are put in
topological order by levels, found round by round with joins.  Arguments are parsed as variants and
held against the schema of their tool.  Messages are serialised with sorted keys and without
spaces, so equal messages are equal strings.

Defined results: arguments that are no JSON object are invalid and are written as a string; a NULL
tool or a tool without schema is invalid; of results with one identifier the first counts, of calls
likewise; results without a call are not linked; calls in a cycle, or that depend on one, have a
NULL level and come last; names of calls that are not in the conversation are errors, not
dependencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmine.llm.common import running_start, settle

# Types of a schema, and the types that a variant of it can have.
TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*>$",
    "object": "^OBJECT<.*>$",
}
REFERENCE = '"\\\\$call"\\\\s*:\\\\s*"([^"]*)"'

Schema = dict[str, dict[str, tuple[str, bool]]]


def schema_errors(tool: str, arguments: str, schemas: Schema) -> Column:
    """What is wrong with the arguments of a call: field names and kinds of fault.

    A schema gives each field a type and whether it is required; other fields are faults.
    """
    value = f"try_parse_json({arguments})"
    kind = f"schema_of_variant({value})"
    checks = F.expr(f"IF(coalesce({kind}, '') NOT LIKE 'OBJECT%', array('no object'), NULL)")
    by_tool = F.array(F.lit("no such tool"))
    for name, fields in sorted(schemas.items()):
        faults = []
        for field, (type_, required) in sorted(fields.items()):
            at = f"schema_of_variant(try_variant_get({value}, '$.{field}', 'variant'))"
            absent = f"'{field}: missing'" if required else "NULL"
            faults.append(
                f"CASE WHEN {at} IS NULL THEN {absent} "
                f"WHEN {at} RLIKE '{TYPES[type_]}' THEN NULL ELSE '{field}: no {type_}' END"
            )
        named = ", ".join(f"'{field}'" for field in sorted(fields)) or "''"
        extra = (
            f"transform(array_except(coalesce(json_object_keys({arguments}), array()), "
            f"array({named})), f -> concat(f, ': unknown'))"
        )
        own = F.expr(f"array_compact(concat(array({', '.join(faults) or 'NULL'}), {extra}))")
        by_tool = F.when(F.col(tool) == name, own).otherwise(by_tool)
    return F.coalesce(checks, by_tool)


def call_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of calls: 0 without dependencies, else one more than the highest.

    ``edges``: ``conv_id, call_id, needs``.  Calls of a round are those whose dependencies all have
    levels; calls that no round reaches have none.  There are as many rounds as levels.
    """
    key = ["conv_id", "call_id"]
    todo = settle(
        calls.select(*key).join(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("open")), key, "left")
        .fillna(0, ["open"]),
        "call-open",
    )
    level, done = 0, todo.where("open = 0").selectExpr(*key, "0 AS level")
    fresh = settle(done, "call-levels")
    found = fresh
    waiting = todo.where("open > 0")
    while fresh.take(1):
        level += 1
        met = (
            edges.join(fresh.selectExpr("conv_id", "call_id AS needs"), ["conv_id", "needs"])
            .groupBy(*key)
            .agg(F.count(F.lit(1)).alias("met"))
        )
        waiting = settle(
            waiting.join(met, key, "left").selectExpr(*key, "open - coalesce(met, 0L) AS open"),
            "call-open",
        )
        fresh = waiting.where("open <= 0").selectExpr(*key, f"{level} AS level")
        found = found.union(fresh)
        waiting = waiting.where("open > 0")
    return found


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schema) -> DataFrame:
    """One row for each call, and one for each linked result, in order of ``place``.

    ``calls``: ``conv_id, turn, call_id, tool, arguments``; ``results``: ``conv_id, turn, call_id,
    content``.  Returns ``conv_id, place, role, call_id, level, linked, valid, errors, message``.
    """
    key = ["conv_id", "call_id"]
    named = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    first_call = F.min(F.struct("turn", "tool", "arguments")).alias("call")
    own = settle(
        calls.where(named).groupBy(*key).agg(first_call).select(*key, "call.*"), "calls"
    )
    given = results.where(named).groupBy(*key).agg(
        F.min(F.struct("turn", "content")).alias("result")
    ).select(*key, F.col("result.turn").alias("result_turn"), F.col("result.content"),
             F.lit(True).alias("linked"))
    listed = own.select(
        *key, F.explode(F.array_distinct(F.expr(
            f"regexp_extract_all(arguments, '{REFERENCE}', 1)"))).alias("needs")
    )
    known = own.selectExpr("conv_id", "call_id AS needs")
    edges = settle(listed.join(known, ["conv_id", "needs"]), "call-edges")
    dangling = listed.join(known, ["conv_id", "needs"], "left_anti").groupBy(*key).agg(
        F.array_sort(F.collect_set(F.concat("needs", F.lit(": no such call")))).alias("dangling")
    )
    joined = (
        own.join(given, key, "left")
        .join(dangling, key, "left")
        .join(call_levels(own, edges), key, "left")
        .withColumn("errors", F.concat(
            schema_errors("tool", "arguments", schemas),
            F.coalesce("dangling", F.array().cast("array<string>"))))
        .withColumn("linked", F.coalesce("linked", F.lit(False)))
    )
    arguments = (
        "coalesce(IF(schema_of_variant(try_parse_json(arguments)) LIKE 'OBJECT%', "
        "to_json(try_parse_json(arguments)), NULL), "
        "to_json(to_variant_object(named_struct('text', arguments))))"
    )
    sort = "coalesce(level, 2147483647) AS _level"
    call = joined.selectExpr(
        *key, sort, "turn AS _turn", "0 AS _part", "'assistant' AS role", "level", "linked",
        "size(errors) = 0 AS valid", "errors",
        f"concat('{{\"role\":\"assistant\",\"tool_calls\":[{{\"arguments\":', {arguments}, "
        "',\"id\":', to_json(to_variant_object(array(call_id))), ',\"name\":', "
        "to_json(to_variant_object(array(tool))), '}]}') AS message",
    )
    result = joined.where("linked").selectExpr(
        *key, sort, "turn AS _turn", "1 AS _part", "'tool' AS role", "level", "linked",
        "size(errors) = 0 AS valid", "errors",
        "concat('{\"content\":', to_json(to_variant_object(array(content))), "
        "',\"role\":\"tool\",\"tool_call_id\":', to_json(to_variant_object(array(call_id))), '}') "
        "AS message",
    )
    both = settle(call.union(result), "call-messages")
    # A stretch of a level, so that a very long conversation is numbered in parts.
    stretch = F.expr("bigint(_level) * 4294967296 + coalesce(_turn, 0) div 1024")
    order = [F.col(c) for c in ("_level", "_turn", "call_id", "_part")]
    placed = running_start(both, ["conv_id"], stretch, order, F.lit(1), "place")
    # A string was wrapped in a list of one, to be escaped; take the brackets off.
    bare = F.regexp_replace("message", '("(?:id|name|content|tool_call_id)":)\\[("(?:[^"\\\\]|\\\\.)*+"|null)\\]', "$1$2")
    return placed.select(
        "conv_id", "place", "role", "call_id", "level", "linked", "valid", "errors",
        bare.alias("message"),
    )
