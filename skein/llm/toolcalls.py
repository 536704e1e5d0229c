"""Chat turns as canonical JSON, with tool calls linked to their results, ordered and checked.

A call is ``<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>`` in a turn's text; a result is
``<tool_result>{"id": ..., "content": ...}</tool_result>`` or a turn of role ``tool`` that is a JSON object with
``tool_call_id``. Calls and results are joined by conversation and identifier. A call depends on another of its conversation
where its arguments hold ``{"$result": "<id>"}``. Sorted by (level, turn, position) the calls of a conversation are in
topological order; no conversation is ever gathered in one place.

A conversation declares its tools in any turn by ``<tools>[{"name": ..., "parameters": {JSON schema}}]</tools>``; its calls are
checked against these, a tool that it doesn't declare being an error. Conversations that declare none are checked against the
schemas given to the operator, if there are any. Schemas are JSON Schema's of 2020-12 but for unevaluated parts, dynamic
references and references out of the schema; a keyword that isn't known makes a call an error, never valid.

JSON that lies deeper than DEPTH is malformed. Lone surrogates, which JSON can write and no text can hold, stay escaped in
arguments and contents; an identifier or name that holds one is malformed.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
RESULT = re.compile(r"<tool_result>(.*?)</tool_result>", re.S)
TOOLS = re.compile(r"<tools>(.*?)</tools>", re.S)
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

CALLS = "conv_id long, turn long, row long, k int, id string, name string, arguments string, error string, needs array<string>"
RESULTS = "conv_id long, turn long, k int, id string, content string"
DECLARED = "conv_id long, turn long, k int, name string, schema string"


#: Objects and arrays one in another that a value may have at most.
DEPTH = 200

LONE = re.compile("[\ud800-\udfff]")
#: Keywords that say something about a schema and nothing about values.
NOTES = frozenset("$schema $id $anchor $comment $defs definitions title description default examples deprecated readOnly writeOnly format contentEncoding contentMediaType".split())
#: Keywords that another one, or this module's check of its kind, reads.
READ = frozenset("minContains maxContains then else".split())


def load(raw: str):
    """JSON, not deeper than DEPTH; ValueError or RecursionError if it is none."""
    value = json.loads(raw)
    level, depth = [value], 0
    while level := [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]:
        depth += 1
        if depth > DEPTH:
            raise ValueError("too deep")
    return value


def _text(value: str) -> str:
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))


def canonical(value) -> str:
    """JSON with sorted keys, no white space, no escapes but those that JSON or a lone surrogate demands; whole floats as integers."""
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("JSON has no such number")
        if value == int(value) and abs(value) < 2**53:
            value = int(value)
        return json.dumps(value)
    if isinstance(value, dict):
        return "{" + ",".join(_text(str(k)) + ":" + canonical(v) for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return _text(value) if isinstance(value, str) else json.dumps(value)


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def same(a, b) -> bool:
    """Equal as JSON: numbers by value, true and false are no numbers."""
    if isinstance(a, bool) or isinstance(b, bool) or not (is_number(a) and is_number(b)):
        if type(a) is not type(b):
            return False
        if isinstance(a, dict):
            return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
        if isinstance(a, list):
            return len(a) == len(b) and all(map(same, a, b))
    return a == b


def _is(kind: str, value) -> bool:
    if kind in ("number", "integer"):
        return is_number(value) and (kind == "number" or value == int(value))
    return isinstance(value, KINDS[kind])


class Checker:
    """Checks values against one schema, references resolved within it: each keyword's method gives a violation or nothing."""

    def __init__(self, root):
        self.root = root

    def referred(self, to: str):
        if not to.startswith("#"):
            raise ValueError(f"reference to {to}")
        at = self.root
        for part in to[1:].split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            at = at[int(part)] if isinstance(at, list) else at[part]
        return at

    def check(self, schema, value, at: str = "$") -> str | None:
        """The first violation, keywords in the order of SIMPLE, then of those about parts."""
        if isinstance(schema, bool):
            return None if schema else f"{at}: not allowed"
        unknown = sorted(k for k in schema if k not in NOTES and k not in READ and k not in SIMPLE and k not in INNER)
        if unknown:
            raise ValueError(f"unknown keyword {unknown[0]}")
        for keyword, (applies, holds, said) in SIMPLE.items():
            if keyword in schema and applies(value) and not holds(value, schema[keyword]):
                return f"{at}: {said(schema[keyword]) if callable(said) else said}"
        for keyword, method in INNER.items():
            if keyword in schema and (error := method(self, schema, schema[keyword], value, at)):
                return error
        return None

    def fits(self, schema, value) -> bool:
        return self.check(schema, value) is None

    def _ref(self, schema, to, value, at):
        return self.check(self.referred(to), value, at)

    def _all(self, schema, parts, value, at):
        return next((error for part in parts if (error := self.check(part, value, at))), None)

    def _any(self, schema, parts, value, at):
        return None if any(self.fits(part, value) for part in parts) else f"{at}: none of anyOf"

    def _one(self, schema, parts, value, at):
        n = sum(self.fits(part, value) for part in parts)
        return None if n == 1 else f"{at}: {n} of oneOf"

    def _not(self, schema, part, value, at):
        return f"{at}: what not forbids" if self.fits(part, value) else None

    def _if(self, schema, part, value, at):
        return self.check(schema.get("then" if self.fits(part, value) else "else", True), value, at)

    def _required(self, schema, keys, value, at):
        return next((f"{at}.{k}: missing" for k in keys if k not in value), None) if isinstance(value, dict) else None

    def _properties(self, schema, _, value, at):
        """properties, patternProperties and additionalProperties, key by key."""
        if not isinstance(value, dict):
            return None
        own, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for k in sorted(value):
            parts = ([own[k]] if k in own else []) + [part for pattern, part in patterns.items() if re.search(pattern, k)]
            for part in parts or [schema.get("additionalProperties", True)]:
                if part is False:
                    return f"{at}.{k}: not allowed"
                if error := self.check(part, value[k], f"{at}.{k}"):
                    return error
        return None

    def _names(self, schema, part, value, at):
        return next((f"{at}.{k}: bad name" for k in sorted(value) if not self.fits(part, k)), None) if isinstance(value, dict) else None

    def _needed(self, schema, parts, value, at):
        return next((f"{at}.{k}: missing" for have in parts if have in value for k in parts[have] if k not in value), None) if isinstance(value, dict) else None

    def _dependent(self, schema, parts, value, at):
        return self._all(schema, [part for have, part in parts.items() if have in value], value, at) if isinstance(value, dict) else None

    def _items(self, schema, _, value, at):
        """prefixItems, then items for the rest."""
        if not isinstance(value, list):
            return None
        first = schema.get("prefixItems", [])
        parts = [*first[: len(value)], *[schema.get("items", True)] * (len(value) - len(first))]
        return next((error for k, (part, x) in enumerate(zip(parts, value)) if (error := self.check(part, x, f"{at}[{k}]"))), None)

    def _contains(self, schema, part, value, at):
        if not isinstance(value, list):
            return None
        n = sum(self.fits(part, x) for x in value)
        return None if schema.get("minContains", 1) <= n <= schema.get("maxContains", n) else f"{at}: {n} that fit contains"


_anything, _string = (lambda v: True), (lambda v: isinstance(v, str))
_array, _object = (lambda v: isinstance(v, list)), (lambda v: isinstance(v, dict))
#: Keyword: which values it is about, whether one holds, what to say of one that doesn't.
SIMPLE = {
    "type": (_anything, lambda v, x: any(_is(k, v) for k in (x if isinstance(x, list) else [x])), lambda x: f"not {'/'.join(x if isinstance(x, list) else [x])}"),
    "enum": (_anything, lambda v, x: any(same(v, y) for y in x), "not in enum"),
    "const": (_anything, same, "not the constant"),
    "minimum": (is_number, lambda v, x: v >= x, "out of range"),
    "maximum": (is_number, lambda v, x: v <= x, "out of range"),
    "exclusiveMinimum": (is_number, lambda v, x: v > x, "out of range"),
    "exclusiveMaximum": (is_number, lambda v, x: v < x, "out of range"),
    "multipleOf": (is_number, lambda v, x: Decimal(str(v)) % Decimal(str(x)) == 0, "no multiple"),
    "pattern": (_string, lambda v, x: re.search(x, v) is not None, "no match"),
    "minLength": (_string, lambda v, x: len(v) >= x, "too short"),
    "maxLength": (_string, lambda v, x: len(v) <= x, "too long"),
    "minItems": (_array, lambda v, x: len(v) >= x, "too few items"),
    "maxItems": (_array, lambda v, x: len(v) <= x, "too many items"),
    "uniqueItems": (_array, lambda v, x: not x or len({canonical(y) for y in v}) == len(v), "repeated items"),
    "minProperties": (_object, lambda v, x: len(v) >= x, "too few properties"),
    "maxProperties": (_object, lambda v, x: len(v) <= x, "too many properties"),
}
INNER = {
    "$ref": Checker._ref, "allOf": Checker._all, "anyOf": Checker._any, "oneOf": Checker._one, "not": Checker._not, "if": Checker._if, "required": Checker._required, "properties": Checker._properties, "patternProperties": Checker._properties,
    "additionalProperties": Checker._properties, "propertyNames": Checker._names, "dependentRequired": Checker._needed, "dependentSchemas": Checker._dependent, "prefixItems": Checker._items, "items": Checker._items, "contains": Checker._contains,
}


def check(schema, value) -> str | None:
    """The first violation of a schema; ValueError and the like for a schema that isn't one."""
    return Checker(schema).check(schema, value)


def _sound(name) -> bool:
    return isinstance(name, str) and not LONE.search(name)


def needs(value) -> set[str]:
    """Identifiers of the results that a value refers to; one that no call can have is none."""
    if isinstance(value, dict):
        own = {value["$result"]} if _sound(value.get("$result")) else set()
        return own.union(*map(needs, value.values()))
    return set().union(*map(needs, value)) if isinstance(value, list) else set()


def read_calls(text: str | None) -> list[tuple]:
    """(k, id, name, canonical arguments, error, needs) of each call of a text; errors of form only."""
    out = []
    for k, m in enumerate(CALL.finditer(text or "")):
        try:
            x = load(m[1])
            arguments = x.get("arguments", {}) if isinstance(x, dict) else None
            if not isinstance(x, dict) or not _sound(x.get("id")) or not _sound(x.get("name")):
                raise ValueError("no id or name")
            out.append((k, x["id"], x["name"], canonical(arguments), None if isinstance(arguments, dict) else "$: not object", sorted(needs(arguments))))
        except (ValueError, RecursionError) as e:
            out.append((k, None, None, None, f"malformed: {type(e).__name__}", []))
    return out


def read_tools(text: str | None) -> list[tuple]:
    """(k, name, schema as JSON) of each well-formed tool that a turn declares; no parameters: an empty schema."""
    out = []
    for m in TOOLS.finditer(text or ""):
        try:
            found = load(m[1])
        except (ValueError, RecursionError):
            continue
        for x in found if isinstance(found, list) else [found]:
            if isinstance(x, dict) and _sound(x.get("name")) and isinstance(x.get("parameters", {}), (dict, bool)):
                out.append((len(out), x["name"], json.dumps(x.get("parameters", {}))))
    return out


def violation(arguments: str, schema: str | None, known: bool) -> str | None:
    """The first violation of a call's schema; known: whether there are schemas for its conversation at all."""
    if not known:
        return None
    if schema is None:
        return "unknown tool"
    try:
        return check(json.loads(schema), json.loads(arguments))
    except (re.error, RecursionError, TypeError, AttributeError, ValueError, ArithmeticError, LookupError) as e:
        return f"bad schema: {e}" if type(e) is ValueError else f"bad schema: {type(e).__name__}"


def read_results(role: str | None, text: str | None) -> list[tuple]:
    """(k, id, content as canonical JSON) of each well-formed result of a turn."""
    found = [m[1] for m in RESULT.finditer(text or "")]
    if not found and role == "tool" and text:
        found = [text]
    out = []
    for k, raw in enumerate(found):
        try:
            x = load(raw)
            key = (x.get("id") or x.get("tool_call_id")) if isinstance(x, dict) else None
            if _sound(key):
                out.append((k, key, canonical(x.get("content"))))
        except (ValueError, RecursionError):
            continue
    return out


def levels(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """conv_id, id, level: 0 unless a call of the conversation needs a later one's result; null in or behind a cycle.

    Only conversations with such a call are layered, a round for each layer, written to the shared folder: as many rounds as the
    longest chain of calls in such a conversation has, each over what still waits.
    """
    key = ["conv_id", "id"]
    edges = calls.select("conv_id", "id", F.struct("turn", "k").alias("at"), F.explode("needs").alias("other"))
    edges = edges.join(calls.select("conv_id", F.col("id").alias("other"), F.struct("turn", "k").alias("other_at")), ["conv_id", "other"])
    edges = common.cut(spark, edges, "needs")
    odd = edges.where("other_at >= at").select("conv_id").distinct()
    rest = calls.select(*key).join(odd, "conv_id", "left_semi")
    links = edges.join(odd, "conv_id", "left_semi").select("conv_id", "id", "other")
    done = calls.select(*key).join(odd, "conv_id", "left_anti").withColumn("level", F.lit(0))
    waiting, n, path = common.cut(spark, rest, "waiting"), 0, common.shared_dir(spark, "layers")
    schema = "conv_id long, id string, level int"
    while True:
        blocked = links.join(waiting.withColumnRenamed("id", "other"), ["conv_id", "other"], "left_semi").select(*key).distinct()
        waiting.join(blocked, key, "left_anti").write.parquet(f"{path}/level={n}")
        free = spark.read.schema("conv_id long, id string").parquet(f"{path}/level={n}")
        if free.isEmpty():
            break
        waiting, n = common.cut(spark, waiting.join(free, key, "left_anti"), "waiting"), n + 1
    layered = spark.read.schema(schema).parquet(path).select(*key, "level")
    return done.unionByName(layered).unionByName(waiting.withColumn("level", F.lit(None).cast("int")))


def format_turns(spark: SparkSession, turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, role, n_calls, n_linked, n_invalid and message of each row of ``turns`` (conv_id, turn, role, text).

    message is canonical JSON: content (the text less its calls), role, and tool_calls in topological order if there are any,
    each with arguments, error, id, level, name and result. Of calls or results that share conversation and identifier the
    first by (turn, position) counts. Null text or role is JSON null; equal rows each have their row; a null conv_id or turn
    links with nothing. Of a tool declared more than once the first schema counts. A call that is no JSON object with an id and a
    name, or is deeper than DEPTH, is malformed: an invalid call without a name. A schema that is none or holds an unknown keyword
    makes its calls invalid. More columns are not read. No rows: no rows.
    """
    common.bounded_batches(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("row", F.xxhash64("role", "text"))

    def calls_of(batches):
        import pyarrow as pa

        for b in batches:
            got = [(c, t, r, *x) for c, t, r, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 4, 3))) for x in read_calls(text)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], t) for k, t in enumerate(types)], ["conv_id", "turn", "row", "k", "id", "name", "arguments", "error", "needs"])

    def results_of(batches):
        import pyarrow as pa

        for b in batches:
            got = [(c, t, *x) for c, t, role, text in zip(*(b.column(k).to_pylist() for k in range(4))) for x in read_results(role, text)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], t) for k, t in enumerate(types)], ["conv_id", "turn", "k", "id", "content"])

    def tools_of(batches):
        import pyarrow as pa

        for b in batches:
            got = [(c, t, *x) for c, t, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))) for x in read_tools(text)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], t) for k, t in enumerate(types)], ["conv_id", "turn", "k", "name", "schema"])

    def checked(batches):
        import pyarrow as pa

        for b in batches:
            arguments, errors, declared, known = (b.column(k).to_pylist() for k in (6, 7, 9, 10))
            names = b.column(5).to_pylist()
            found = []
            for name, a, error, schema, own in zip(names, arguments, errors, declared, known):
                given = None if schemas is None or name not in schemas else json.dumps(schemas[name])
                found.append(error or violation(a, schema if own else given, bool(own) or bool(schemas)))
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(found, pa.string()), b.column(8)], b.schema.names[:9])

    has_call = F.coalesce(F.contains("text", F.lit("<tool_call>")), F.lit(False))
    calls = rows.where(has_call).mapInArrow(calls_of, CALLS).distinct()
    tools = rows.where(F.contains("text", F.lit("<tools>"))).mapInArrow(tools_of, DECLARED).where("conv_id is not null")
    tools = common.cut(spark, tools.groupBy("conv_id", "name").agg(F.min_by("schema", F.struct("turn", "k")).alias("schema")), "tools")
    own = tools.select("conv_id").distinct().withColumn("known", F.lit(True))
    calls = calls.join(tools, ["conv_id", "name"], "left").join(own, "conv_id", "left").select("conv_id", "turn", "row", "k", "id", "name", "arguments", "error", "needs", "schema", "known")
    calls = common.cut(spark, calls.mapInArrow(checked, CALLS), "calls")
    linked = None
    if not calls.isEmpty():
        results = rows.where((F.col("role") == "tool") | F.contains("text", F.lit("<tool_result>"))).mapInArrow(results_of, RESULTS)
        results = results.groupBy("conv_id", "id").agg(F.min_by("content", F.struct("turn", "k")).alias("result"))
        named = calls.where("id is not null")
        firsts = named.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "k", "needs")).alias("x")).select("conv_id", "id", "x.*")
        known = firsts.select("conv_id", "id").join(results, ["conv_id", "id"], "left").join(levels(spark, firsts), ["conv_id", "id"], "left")
        each = calls.join(known, ["conv_id", "id"], "left")
        linked = each.groupBy("conv_id", "turn", "row").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit(1 << 30)).alias("o"), "k", "id", "name", "arguments", "error", "level", "result"))).alias("calls"))
    columns = ["conv_id", "turn", "role", "text"]
    plain = rows.where(~has_call) if linked is not None else rows
    out = plain.select(*columns, F.lit(None).cast("string").alias("calls"))
    if linked is not None:
        key = [rows[c].eqNullSafe(linked[c]) for c in ("conv_id", "turn", "row")]
        out = out.unionByName(rows.where(has_call).join(linked, key, "left").select(*[rows[c] for c in columns], F.to_json("calls").alias("calls")))

    def render(batches):
        import pyarrow as pa

        for b in batches:
            n_calls, n_linked, n_invalid, messages = [], [], [], []
            for role, text, raw in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                calls = json.loads(raw) if raw else []
                message = {"content": text if not calls or text is None else CALL.sub("", text).strip(), "role": role}
                if calls:
                    message["tool_calls"] = [{"arguments": json.loads(c["arguments"]) if c.get("arguments") else None, "error": c.get("error"), "id": c.get("id"), "level": c.get("level"), "name": c.get("name"), "result": json.loads(c["result"]) if c.get("result") else None} for c in calls]
                n_calls.append(len(calls))
                n_linked.append(sum(c.get("result") is not None for c in calls))
                n_invalid.append(sum(c.get("error") is not None for c in calls))
                messages.append(canonical(message))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(x, pa.int64()) for x in (n_calls, n_linked, n_invalid)], pa.array(messages, pa.string())], ["conv_id", "turn", "role", "n_calls", "n_linked", "n_invalid", "message"])

    return out.mapInArrow(render, "conv_id long, turn long, role string, n_calls long, n_linked long, n_invalid long, message string")


def _sql(turns: str) -> str:
    """DuckDB: calls with their links and errors of form, of ``turns`` (conv_id, turn, role, text); schemas are not expressed."""
    return rf"""
WITH RECURSIVE turns AS ({turns}),
c0 AS (SELECT conv_id, turn, role, text, unnest(regexp_extract_all(text, '<tool_call>(.*?)</tool_call>', 1, 's')) AS raw, generate_subscripts(regexp_extract_all(text, '<tool_call>(.*?)</tool_call>', 1, 's'), 1) AS k FROM (SELECT DISTINCT conv_id, turn, role, text FROM turns)),
calls AS (SELECT * EXCLUDE (raw), CASE WHEN json_valid(raw) AND json_type(raw, '$.id') = 'VARCHAR' AND json_type(raw, '$.name') = 'VARCHAR' THEN raw END AS call FROM c0),
r0 AS (SELECT conv_id, unnest(CASE WHEN contains(text, '<tool_result>') THEN regexp_extract_all(text, '<tool_result>(.*?)</tool_result>', 1, 's') WHEN role = 'tool' THEN [text] ELSE [] END) AS raw FROM turns),
results AS (SELECT DISTINCT conv_id, coalesce(raw ->> '$.id', raw ->> '$.tool_call_id') AS id FROM r0 WHERE json_valid(raw)),
t0 AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '<tools>(.*?)</tools>', 1, 's')) AS raw FROM turns),
tools AS (SELECT conv_id, tool ->> '$.name' AS name, arg_min(tool -> '$.parameters', turn) AS schema FROM (SELECT conv_id, turn, unnest(from_json(raw, '["JSON"]')) AS tool FROM t0 WHERE json_valid(raw)) GROUP BY ALL),
linked AS (SELECT calls.*, call ->> '$.id' AS id, call ->> '$.name' AS name, results.id IS NOT NULL AS has_result, tools.schema, EXISTS (SELECT 1 FROM tools t WHERE t.conv_id = calls.conv_id) AS known
 FROM calls LEFT JOIN results ON results.conv_id = calls.conv_id AND results.id = call ->> '$.id' LEFT JOIN tools ON tools.conv_id = calls.conv_id AND tools.name = call ->> '$.name'),
judged AS (SELECT *, call IS NULL OR (known AND (schema IS NULL OR coalesce((call ->> '$.arguments.n')::BIGINT > (schema ->> '$.properties.n.maximum')::BIGINT, false) OR (coalesce(schema ->> '$.required[0]', '') = 'n' AND (call -> '$.arguments.n') IS NULL))) AS wrong FROM linked),
per AS (SELECT conv_id, turn, role, text, count(*) AS n_calls, count(*) FILTER (has_result) AS n_linked, count(*) FILTER (wrong) AS n_invalid FROM judged GROUP BY ALL)"""


#: DuckDB SQL for ``format_turns`` over conversations whose calls, if any, take a number n; the message of turns without a call.
ORACLE = (
    _sql("SELECT conv_id, turn, role, text FROM conversations")
    + """ SELECT c.conv_id, c.turn, c.role, coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(n_invalid, 0)::BIGINT AS n_invalid,
 CASE WHEN n_calls IS NULL THEN to_json({'content': c.text, 'role': c.role})::VARCHAR END AS message
FROM conversations c LEFT JOIN per ON per.conv_id = c.conv_id AND per.turn = c.turn AND per.role IS NOT DISTINCT FROM c.role AND per.text IS NOT DISTINCT FROM c.text"""
)

#: Turns of conversations with calls put in, the same text for both engines. Each assistant's turn calls a tool; every third
#: conversation's calls need the result of the next one, the others' that of the one before; two of three turns after a call
#: hold its result; every second conversation declares one tool of the two.
MADE = """
SELECT conv_id, turn, role, concat(coalesce(text, ''),
 CASE WHEN role = 'assistant' THEN concat('<tool_call>{"id": "c', turn, '", "name": "', CASE WHEN conv_id % 5 = 0 THEN 'find' ELSE 'count' END, '", "arguments": {"n": ', length(text), ', "of": {"$result": "c', CASE WHEN conv_id % 3 = 0 THEN turn + 2 ELSE turn - 2 END, '"}}}</tool_call>') ELSE '' END,
 CASE WHEN role <> 'assistant' AND (conv_id + turn) % 3 > 0 THEN concat('<tool_result>{"id": "c', turn - 1, '", "content": ', turn, '}</tool_result>') ELSE '' END,
 CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN '<tools>[{"name": "count", "parameters": {"required": ["n"], "properties": {"n": {"type": "integer", "maximum": 300}}}}]</tools>' ELSE '' END) AS text
FROM {conversations}
"""

#: Levels: calls without an earlier one to wait for first, then a level for each step; only where some call needs a later one.
MADE_ORACLE = (
    _sql(MADE.replace("{conversations}", "conversations"))
    + """, e AS (SELECT a.conv_id, a.id, a.turn, b.id AS other, b.turn AS other_turn FROM judged a JOIN judged b ON a.conv_id = b.conv_id AND b.id = a.call ->> '$.arguments.of."$result"'),
odd AS (SELECT DISTINCT conv_id FROM e WHERE other_turn >= turn),
walk(conv_id, id, level) AS (SELECT conv_id, id, 0 FROM judged UNION SELECT e.conv_id, e.id, level + 1 FROM walk JOIN e ON e.conv_id = walk.conv_id AND e.other = walk.id),
lev AS (SELECT w.conv_id, id, CASE WHEN odd.conv_id IS NULL THEN 0 ELSE level END AS level FROM (SELECT conv_id, id, max(level) AS level FROM walk GROUP BY ALL) w LEFT JOIN odd ON odd.conv_id = w.conv_id)
SELECT per.conv_id, per.turn, n_calls, n_linked, n_invalid, lev.level::BIGINT AS level FROM per JOIN judged USING (conv_id, turn) JOIN lev ON lev.conv_id = per.conv_id AND lev.id = judged.id"""
)
