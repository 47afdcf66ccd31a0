"""Linking tool calls with their results.

Calls and results meet in a hash join on (conversation, call id). A call may consume the result of one earlier call, its parent; levels in
that forest come from pointer doubling, so a chain of n calls takes log n joins, and what still points somewhere after that is a cycle. Within
a conversation calls are placed by level, then turn. Arguments are parsed, checked against the tool's schema and written as
canonical JSON (sorted keys, no blanks, UTF-8).
"""
import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse
from .common import same

TURNS = 1024  # turns of a conversation that are ranked together
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


# Keywords that are checked, and those that only describe; any other is refused.
_CHECKED = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems",
            "maxItems", "items", "properties", "required", "additionalProperties", "anyOf", "oneOf", "allOf"}
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}


def check_schema(schema, at="$"):
    """Fails on a schema with a keyword that ``violations`` does not check."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: not a schema")
    if unknown := sorted(set(schema) - _CHECKED - _NOTES):
        raise ValueError(f"{at}: keywords that are not checked: {', '.join(unknown)}")
    kinds = schema.get("type", [])
    if unknown := {*(kinds if isinstance(kinds, list) else [kinds])} - {*_KINDS, "number", "integer"}:
        raise ValueError(f"{at}: no such type: {', '.join(sorted(map(str, unknown)))}")
    for k, v in schema.get("properties", {}).items():
        check_schema(v, f"{at}.{k}")
    for k in ("items", "additionalProperties"):
        if k in schema:
            check_schema(schema[k], f"{at}.{k}")
    for k in ("anyOf", "oneOf", "allOf"):
        for v in schema.get(k, []):
            check_schema(v, f"{at}.{k}")


def _equal(a, b):
    """Equality of JSON values: true is not 1."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(v, b[k]) for k, v in a.items())
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def _fits(value, kind):
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _KINDS[kind])


def violations(value, schema, at="$"):
    """What is wrong with a parsed value under a schema of the keywords that ``check_schema`` lets through."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind is not None and not any(_fits(value, k) for k in (kind if isinstance(kind, list) else [kind])):
        return [f"{at}: not of type {' or '.join(kind) if isinstance(kind, list) else kind}"]
    out = []
    if "enum" in schema and not any(_equal(value, v) for v in schema["enum"]):
        out.append(f"{at}: not among the allowed values")
    if "const" in schema and not _equal(value, schema["const"]):
        out.append(f"{at}: not the allowed value")
    if number and "minimum" in schema and value < schema["minimum"]:
        out.append(f"{at}: below {schema['minimum']}")
    if number and "maximum" in schema and value > schema["maximum"]:
        out.append(f"{at}: above {schema['maximum']}")
    if number and "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
        out.append(f"{at}: not above {schema['exclusiveMinimum']}")
    if number and "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
        out.append(f"{at}: not below {schema['exclusiveMaximum']}")
    if isinstance(value, (str, list)) and len(value) > schema.get("maxLength" if isinstance(value, str) else "maxItems", math.inf):
        out.append(f"{at}: too long")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: not of the pattern")
    for v in schema.get("allOf", []):
        out += violations(value, v, at)
    if "anyOf" in schema and all(violations(value, v, at) for v in schema["anyOf"]):
        out.append(f"{at}: none of the alternatives")
    if "oneOf" in schema and sum(not violations(value, v, at) for v in schema["oneOf"]) != 1:
        out.append(f"{at}: not exactly one of the alternatives")
    if isinstance(value, (str, list)) and len(value) < schema.get("minLength" if isinstance(value, str) else "minItems", 0):
        out.append(f"{at}: too short")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not known")
            else:
                out += violations(value[k], schema.get("additionalProperties", True), f"{at}.{k}")
    return out


def _plain(value):
    """Whole numbers without a fraction, so that 1 and 1.0 are written alike."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def canonical(value):
    value = _plain(value)
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # half of a surrogate pair cannot be written as UTF-8
        text = json.dumps(value, sort_keys=True, separators=(",", ":"))
    return text


def _no_constant(name):
    raise ValueError(f"{name} is not JSON")


def _finite(text):
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is too large")
    return value


def _once(pairs):
    value = dict(pairs)
    if len(value) < len(pairs):
        raise ValueError("a key is repeated")
    return value


def parse(text):
    """(value, problem) of a JSON text. Numbers beyond doubles, literals such as NaN and objects that repeat a key are not taken."""
    try:
        return json.loads(text, parse_constant=_no_constant, parse_float=_finite, object_pairs_hook=_once), None
    except (ValueError, TypeError, RecursionError):
        return None, "$: not JSON"


def check_call(tool, arguments, schemas):
    value, problem = parse(arguments)
    if problem:
        return None, [problem]
    if tool not in schemas:
        return value, ["no such tool"]
    return value, violations(value, schemas[tool])


def _describe(schemas: dict):
    for tool, schema in schemas.items():
        check_schema(schema, tool)

    @F.pandas_udf("problems array<string>, json string")
    def run(d: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in d.itertuples(index=False):
            call = None
            problems = []
            if r.has_call:
                value, problems = check_call(r.tool, r.arguments, schemas)
                call = {"name": r.tool, "arguments": r.arguments if problems == ["$: not JSON"] else value}
            result = None
            if r.has_result:
                value, bad = parse(r.content)
                result = r.content if bad or not isinstance(value, (dict, list)) else value
            out.append((problems, canonical({"id": r.call_id, "call": call, "result": result})))
        return pd.DataFrame(out, columns=["problems", "json"])
    return run


def levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level, cyclic) of (conv, call_id, parent): 0 without a parent in the table, else one more than the parent."""
    keyed = calls.select("conv", "call_id", "parent")
    up = keyed.select(F.col("conv").alias("c2"), F.col("call_id").alias("parent"), F.lit(True).alias("found"))
    # ``up`` is where a call points, ``level`` the steps made to get there; a call whose pointer ran out is at its level.
    now = reuse(keyed.join(up, same(F.col("conv"), F.col("c2")) & (keyed["parent"] == up["parent"]), "left")
                .select("conv", "call_id", F.when(F.col("found"), keyed["parent"]).alias("up"))
                .withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")))
    rounds = math.ceil(math.log2(now.count() + 2)) + 1
    for _ in range(rounds):
        if now.where(F.col("up").isNotNull()).isEmpty():
            break
        at = now.select(F.col("conv").alias("c2"), F.col("call_id").alias("id2"), F.col("up").alias("up2"), F.col("level").alias("more"))
        now = reuse(now.join(at, same(F.col("conv"), F.col("c2")) & (F.col("up") == F.col("id2")), "left")
                    .select("conv", "call_id", F.col("up2").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
    lost = F.col("up").isNotNull()
    return now.select("conv", "call_id", F.when(~lost, F.col("level")).alias("level"), lost.alias("cyclic"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per call id of a conversation: conv, call_id, place, level, turn, tool, status, valid, problems, json.

    ``calls``: conv, turn, call_id, tool, arguments (JSON text), parent. ``results``: conv, turn, call_id, content. Status: linked, unanswered, orphan (a
    result without a call), early (the result comes first). Of rows that repeat an id the first by turn counts, and the repeat is a
    problem. Rows with a null id cannot be linked and are left out; a null conversation is one of its own. ``place`` numbers the calls of a conversation from 0 by
    level, turn and id; calls on or behind a cycle have neither level nor place. Unknown parents are a problem and count as none.
    Further columns are ignored; empty tables give no rows.
    """
    c = (calls.where("call_id is not null").groupBy("conv", "call_id")
         .agg(F.min(F.struct("turn", "tool", "arguments", "parent")).alias("call"), F.count("*").alias("n_calls")))
    c = reuse(c.select("conv", "call_id", "n_calls", "call.*"))
    r = (results.where("call_id is not null").groupBy(F.col("conv").alias("conv_r"), F.col("call_id").alias("id_r"))
         .agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results")))
    lv = reuse(levels(c)).withColumnsRenamed({"conv": "conv_l", "call_id": "id_l"})
    known = c.join(lv, same(F.col("conv"), F.col("conv_l")) & (F.col("call_id") == F.col("id_l"))).drop("conv_l", "id_l")
    known = _placed(known)
    j = known.withColumn("has_call", F.lit(True)).join(r, same(F.col("conv"), F.col("conv_r")) & (F.col("call_id") == F.col("id_r")), "full")
    has_call, has_result = F.coalesce("has_call", F.lit(False)), F.col("id_r").isNotNull()
    status = (F.when(~has_call, "orphan").when(~has_result, "unanswered").when(F.col("result.turn") < F.col("turn"), "early").otherwise("linked"))
    j = j.select(F.coalesce("conv", "conv_r").alias("conv"), F.coalesce("call_id", "id_r").alias("call_id"), "place", "level", "cyclic", "parent", "n_calls",
                 "n_results", F.coalesce("turn", "result.turn").alias("turn"), "tool", "arguments", F.col("result.content").alias("content"),
                 status.alias("status"), has_call.alias("has_call"), has_result.alias("has_result"))
    j = j.withColumn("seen", _describe(schemas)(F.struct("call_id", "tool", "arguments", "content", "has_call", "has_result")))
    extra = F.array(F.when(F.col("n_calls") > 1, "repeated call id"), F.when(F.col("n_results") > 1, "repeated result"), F.when(F.col("cyclic"), "cycle"),
                    F.when((F.col("level") == 0) & F.col("parent").isNotNull(), "unknown parent"))
    problems = F.concat(F.col("seen.problems"), F.filter(extra, lambda p: p.isNotNull()))
    return (j.withColumn("problems", problems).withColumn("json", F.col("seen.json"))
            .select("conv", "call_id", "place", "level", "turn", "tool", "status", (F.col("has_call") & (F.size("problems") == 0)).alias("valid"), "problems", "json"))


def _placed(calls):
    """Adds ``place``: ranks within (conversation, level, block of turns), plus what stands before that block."""
    calls = calls.withColumn("block", F.expr(f"turn div {TURNS}"))
    sizes = calls.where("level is not null").groupBy("conv", "level", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("level", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv").alias("conv_s"), F.col("level").alias("level_s"), F.col("block").alias("block_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    rank = F.row_number().over(Window.partitionBy("conv", "level", "block").orderBy("turn", "call_id")) - 1
    on = same(F.col("conv"), F.col("conv_s")) & (F.col("level") == F.col("level_s")) & same(F.col("block"), F.col("block_s"))
    return (calls.withColumn("i", rank).join(sizes, on, "left").withColumn("place", F.col("n0") + F.col("i"))
            .drop("conv_s", "level_s", "block_s", "n0", "i", "block"))


#: The tools of the stand-in calls.
TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "calculate": {"type": "object", "required": ["expression"],
                  "properties": {"expression": {"type": "string", "minLength": 3}, "precision": {"type": "integer", "minimum": 0, "maximum": 15}}},
    "fetch": {"type": "object", "required": ["url"], "properties": {"url": {"type": "string"}, "method": {"enum": ["GET", "HEAD"]}}},
}


def calls_in(turns: DataFrame):
    """(calls, results) that stand in for tool traffic: each assistant turn calls a tool with arguments cut from its text, each other turn but
    the first answers the turn before it; some calls consume the result of the call two turns earlier."""
    text, n = F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit("")))
    head = F.substring_index(text, " ", 5)
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), (n % 3 + 1).cast("int"))
    args = (F.when(tool == "search", F.to_json(F.struct(head.alias("query"), (n % 60).alias("limit"))))
            .when(tool == "calculate", F.to_json(F.struct((n % 18).alias("precision"), F.substring(text, 1, 40).alias("expression"))))
            .otherwise(F.to_json(F.struct(F.concat(F.lit("https://example.com/"), n.cast("string")).alias("url"), F.when(n % 7 > 0, "GET").otherwise("PUT").alias("method")))))

    def call_id(turn: Column):
        return F.concat(F.lit("call-"), turn.cast("string"))

    t = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    parent = F.when((n % 4 != 0) & (F.col("turn") > 1), call_id(F.col("turn") - 2))
    calls = t.where("role = 'assistant'").select("conv", "turn", call_id(F.col("turn")).alias("call_id"), tool.alias("tool"), args.alias("arguments"), parent.alias("parent"))
    results = t.where("role <> 'assistant' and turn > 0").select("conv", "turn", call_id(F.col("turn") - 1).alias("call_id"), text.alias("content"))
    return calls, results
