"""Chat formatting: tool-call linking [native].

Calls (``conv_id, call_id, position, name, arguments, parents``) meet results
(``conv_id, call_id, position, content``) in one hash join on both identifiers, so a
conversation of any length is spread over all tasks. Calls are ordered topologically:
``level`` is the longest chain of parents, found by doubling over all parents at once
(``levels``), so a chain of n calls takes about log2 n rounds however many parents each has.
Arguments are validated against a JSON schema per tool (types, required fields, nested
objects, arrays and enumerations) and written, with identifier, name and result, as
canonical JSON (sorted keys, no spaces; ``VARIANT`` keeps number and string types).

Defined results: a call without a result has a null result and ``linked`` false; of
several results of one identifier the first by position, then content, counts; results
without a call are ignored; calls that share an identifier are one call (the first by
position, then by its other fields); unknown parents are errors (``unknown parent``) and
do not count for levels; calls on or behind a cycle of parents get level -1 and the error
``cycle``; null or malformed arguments fail validation (``not an object``) and are written
as null; a tool without a schema accepts any object; rows with a null conversation or call
identifier are dropped; contents and arguments of any length are carried whole; columns
beyond those named above are left out, so none can clash; empty tables give empty results.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import materialise

#: JSON schema types and the Variant types that satisfy them.
_TYPES = {"string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "null": r"^VOID$", "object": r"^OBJECT", "array": r"^ARRAY"}
Schema = dict[str, Any]


def _strings(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast("array<string>")


def _violations(value: Column, schema: Schema, path: str) -> Column:
    """Array of what is wrong with a Variant that is there, by a schema of type, enum, properties, required and items."""
    kind = F.schema_of_variant(value)
    fits = F.coalesce(kind.rlike(_TYPES[schema["type"]]), F.lit(False)) if "type" in schema else F.lit(True)
    found = [_strings(F.when(~fits, F.lit(f"{path} is no {schema.get('type')}")))]
    if "enum" in schema:
        allowed = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]]
        found.append(_strings(F.when(fits & ~F.to_json(value).isin(*allowed), F.lit(f"{path} is none of its values"))))
    nothing = F.array().cast("array<string>")
    for name, inner in sorted(schema.get("properties", {}).items()):
        field, at = F.try_variant_get(value, f"$['{name}']", "variant"), f"{path}.{name}" if path else name
        missing = field.isNull() | ((F.schema_of_variant(field) == "VOID") & F.lit(inner.get("type") != "null"))
        absent = _strings(F.lit(f"missing {at}")) if name in schema.get("required", ()) else nothing
        found.append(F.when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), nothing).when(missing, absent).otherwise(_violations(field, inner, at)))
    if "items" in schema:
        each = F.try_variant_get(value, "$", "array<variant>")
        found.append(F.coalesce(F.array_distinct(F.flatten(F.transform(each, lambda x: _violations(x, schema["items"], f"{path}[]")))), nothing))
    return F.concat(*found)


def validation_errors(arguments: Column, name: Column, schemas: dict[str, Schema]) -> Column:
    """Array of the errors of a Variant under the schema of its tool."""
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    nothing = F.array().cast("array<string>")
    own = [F.when(is_object & (name == tool), _violations(arguments, schema, "")).otherwise(nothing) for tool, schema in sorted(schemas.items())]
    return F.concat(_strings(F.when(~is_object, F.lit("not an object"))), *own)


def levels(calls: DataFrame) -> DataFrame:
    """``node`` and ``level`` for calls (``node``, ``group``, ``position``, ``parents``: known ones); -1 on and behind cycles.

    A call's level is the larger of what is ``known`` of it and, over its open edges
    (parent, weight), of the parent's level plus weight. A round replaces every edge by its
    parent's edges, so edges span twice as many steps each time. Before that an edge goes
    if a path over a later parent is as long; that keeps edges as few as the graph is wide.
    Edges that are left when they span more steps than a group has calls lead to a cycle.
    """
    known = calls.select("node", F.lit(0).cast("long").alias("known"))
    place = calls.select(F.col("node").alias("parent"), F.col("position").alias("at"))
    edges = calls.select("node", F.explode(F.array_distinct("parents")).alias("parent")).join(place, "parent").select("node", "parent", "at", F.lit(1).cast("long").alias("weight"))
    edges = materialise(edges, "links-edges")
    longest = calls.groupBy("group").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).collect()[0][0]
    span = 1
    while span <= longest and not edges.isEmpty():
        below = edges.select(F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("at").alias("next_at"), F.col("weight").alias("more"))
        if not edges.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            detour = edges.join(below, "parent").where("at > next_at").groupBy("node", F.col("next").alias("parent")).agg(F.max(F.col("weight") + F.col("more")).alias("detour"))
            edges = materialise(edges.join(detour, ["node", "parent"], "left").where("detour IS NULL OR detour < weight").select("node", "parent", "at", "weight"), "links-edges")
            below = edges.select(F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("at").alias("next_at"), F.col("weight").alias("more"))
        reached = edges.join(known.select(F.col("node").alias("parent"), F.col("known").alias("above")), "parent").groupBy("node").agg(F.max(F.col("above") + F.col("weight")).alias("above"))
        known = materialise(known.join(reached, "node", "left").select("node", F.greatest("known", F.coalesce("above", "known")).alias("known")), "links-known")
        stepped = edges.join(below, "parent").groupBy("node", F.col("next").alias("parent"), F.col("next_at").alias("at")).agg(F.max(F.col("weight") + F.col("more")).alias("weight"))
        edges = materialise(stepped, "links-edges")
        span *= 2
    caught = edges.select("node").distinct().withColumn("caught", F.lit(True))
    return known.join(caught, "node", "left").select("node", F.when(F.col("caught"), -1).otherwise(F.col("known")).cast("long").alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row per call with its result, level, validation errors and canonical JSON."""
    key = lambda c, i: F.concat_ws("\x1f", F.col(c).cast("string"), F.col(i).cast("string"))
    named = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).withColumn("node", key("conv_id", "call_id"))
    fields = ["conv_id", "call_id", "name", "arguments", "parents"]
    single = named.groupBy("node").agg(F.min(F.struct("position", *fields)).alias("c")).select("node", "c.position", *[F.col(f"c.{f}") for f in fields])
    single = materialise(single, "links-calls")
    wanted = single.select("node", "conv_id", F.posexplode(F.coalesce("parents", F.array().cast("array<string>"))).alias("nth", "parent")).where("parent IS NOT NULL")
    known = wanted.withColumn("up", key("conv_id", "parent")).join(single.select(F.col("node").alias("up"), F.lit(True).alias("there")), "up", "left")
    parents = known.groupBy("node").agg(F.sort_array(F.collect_list(F.when(F.col("there"), F.struct("nth", "up")))).alias("ups"), F.count_if(F.col("there").isNull()).alias("unknown"))
    single = materialise(single.join(parents, "node", "left").withColumn("ups", F.coalesce(F.col("ups.up"), F.array().cast("array<string>"))).withColumn("unknown", F.coalesce("unknown", F.lit(0))), "links-known")
    level = levels(single.select("node", F.col("conv_id").alias("group"), "position", F.col("ups").alias("parents")))
    answers = results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy(key("conv_id", "call_id").alias("node")).agg(F.min(F.struct("position", "content")).alias("r"))
    linked = single.join(answers, "node", "left").join(level, "node")
    parsed = F.try_parse_json("arguments")
    errors = F.concat(validation_errors(parsed, F.col("name"), schemas), F.array_compact(F.array(F.when(F.col("unknown") > 0, F.lit("unknown parent")), F.when(F.col("level") < 0, F.lit("cycle")))))
    canonical = F.to_json(F.struct(parsed.alias("arguments"), F.col("call_id").alias("id"), F.col("name"), F.col("r.content").alias("result")), {"ignoreNullFields": "false"})
    return linked.select(
        "conv_id", F.col("position").alias("turn"), "call_id", "level", F.col("r.position").alias("result_turn"), F.col("r").isNotNull().alias("linked"),
        (F.size(errors) == 0).alias("valid"), F.array_join(errors, "; ").alias("errors"), canonical.alias("json"),
    )


#: Tools of the conversation table: user turns ask for an answer, system turns set the scene.
CHAT_TOOLS: dict[str, Schema] = {
    "answer": {"type": "object", "properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["text", "turn"]},
    "setting": {"type": "object", "properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["text"]},
}


def op2_tool_links(spark, sf_dir: str) -> DataFrame:
    """User and system turns of ``conversations`` as calls, each following the call two turns before; assistant turns as results of the turn before."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    turn = F.col("turn")
    arguments = F.to_json(F.struct(F.col("text"), turn.alias("turn")))
    calls = turns.where(F.col("role").isin("user", "system")).select(
        "conv_id", name(turn).alias("call_id"), turn.alias("position"), F.when(F.col("role") == "user", "answer").otherwise("setting").alias("name"), arguments.alias("arguments"),
        F.when(turn >= 2, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("parents"),
    )
    results = turns.where(F.col("role") == "assistant").select("conv_id", name(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    return link_calls(calls, results, CHAT_TOOLS).withColumn("result_turn", F.coalesce("result_turn", F.lit(-1).cast("long")))


OP2_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, min(CASE WHEN role = 'user' THEN 'answer' ELSE 'setting' END) AS name, arg_min(text, (CASE WHEN role = 'user' THEN 'answer' ELSE 'setting' END, '{"text":' || CAST(to_json(text) AS VARCHAR))) AS text
  FROM conversations WHERE role IN ('user', 'system') AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
l AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2),
r AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn),
j AS (SELECT c.conv_id, c.turn, 'call_' || c.turn AS call_id, l.level, r.turn AS result_turn, r.turn IS NOT NULL AS linked, c.name, c.text, r.text AS result,
        (c.turn >= 2 AND l.level = 0) AS unknown
      FROM c JOIN l USING (conv_id, turn) LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1)
SELECT conv_id, turn, call_id, level, coalesce(result_turn, -1) AS result_turn, linked, NOT unknown AND text IS NOT NULL AS valid,
  CASE WHEN text IS NULL AND unknown THEN 'missing text; unknown parent' WHEN text IS NULL THEN 'missing text' WHEN unknown THEN 'unknown parent' ELSE '' END AS errors,
  '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || CAST(to_json(text) AS VARCHAR) || ',' END || '"turn":' || turn || '},"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS json
FROM j
"""
