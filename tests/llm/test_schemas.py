"""Schemas of tool calls: each keyword, random schemas against predicates made beside them, and turns that must not end a job."""

import json
import random

import pytest

from skein.llm import toolcalls

CASES = [
    ({"const": 1}, [1, 1.0], [True, "1", 2]), ({"enum": [1, None, [0]]}, [1, None, [0]], [True, False, [False], 0]), ({"type": ["integer", "null"]}, [3, 3.0, None], [3.5, True, "3"]), ({"exclusiveMinimum": 2, "exclusiveMaximum": 4}, [3, "x"], [2, 4, 1]),
    ({"multipleOf": 0.1}, [0.3, 1, "x"], [0.35]), ({"minLength": 2, "maxLength": 3}, ["ab", "é🙂x", 5], ["a", "abcd"]), ({"pattern": "^a+$"}, ["aa", 1], ["ab"]), ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[1], [1, True], {}], [[], [1, 2, 3], [1, 1.0]]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 5, []], [4]), ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, [0, 9], [2, "x"]), ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [2, "x"], [0, 4]), ({"not": {"type": "object"}}, [1, []], [{}]),
    ({"$ref": "#/$defs/tree", "$defs": {"tree": {"type": "object", "properties": {"of": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}}}}, [{"of": [{"of": []}]}], [{"of": [{"of": 1}]}, 3]), ({"$defs": {"a/b": False}, "properties": {"x": {"$ref": "#/$defs/a~1b"}}}, [{"y": 1}], [{"x": 1}]),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"maxProperties": 0}}, [{"a": 1, "b": 2}, {}], [{"a": 1}, {"c": 1}]), ({"properties": {"a": True}, "patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": {"type": "string"}}, [{"a": [], "x1": 2, "z": "s"}, 7], [{"x1": "s"}, {"z": 1}]),
    ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}, 3], [{"abc": 1}]), ({"dependentRequired": {"a": ["b"]}, "dependentSchemas": {"c": {"minProperties": 2}}}, [{"a": 1, "b": 1}, {"c": 1, "d": 2}, {}], [{"a": 1}, {"c": 1}]),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, [["a", 1, 2], ["a"], [], "x"], [[1], ["a", "b"]]), ({"items": False}, [[], {}], [[1]]), ({"contains": {"const": 1}, "minContains": 1, "maxContains": 2}, [[1], [1, 1, 2]], [[], [1, 1, 1]]),
    ({"title": "t", "description": "d", "format": "date", "default": 3}, ["anything", None], []), (True, [1, None], []), (False, [], [1, None]), ({}, [1], []),
]


@pytest.mark.parametrize("schema,good,bad", CASES, ids=lambda x: json.dumps(x)[:30])
def test_keywords(schema, good, bad):
    assert [toolcalls.check(schema, v) for v in good] == [None] * len(good)
    assert all(toolcalls.check(schema, v) for v in bad)


def test_all_keywords_are_covered():
    used = json.dumps([schema for schema, _, _ in CASES])
    assert all(f'"{k}"' in used or k in ("minimum", "maximum", "required", "minProperties") for k in (*toolcalls.SIMPLE, *toolcalls.INNER, *toolcalls.READ))


@pytest.mark.parametrize("schema", [{"unevaluatedProperties": False}, {"properties": {"x": {"minimun": 3}}}, {"$ref": "http://other/schema"}, {"$ref": "#/nowhere"}, {"$ref": "#"}, {"type": "int"}, {"propertyNames": {"pattern": "("}}, {"properties": {"x": {"multipleOf": 0}}}, {"properties": 5}, {"anyOf": 3}])
def test_schemas_that_are_none_are_errors(schema):
    assert toolcalls.violation('{"x": 1}', json.dumps(schema), True).startswith("bad schema")


def drawn(draw, depth=3):
    """A schema and a predicate of the same meaning, told apart in how they are written."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    pick = draw.randrange(9 if depth else 5)
    if pick == 0:
        k = draw.randrange(6)
        return {"minimum": k}, lambda v: not number(v) or v >= k
    if pick == 1:
        n = draw.randrange(4)
        return {"type": "string", "maxLength": n}, lambda v: isinstance(v, str) and len(v) <= n
    if pick == 2:
        k = draw.choice([0, 1, "a", None, True])
        return {"const": k}, lambda v: v == k and isinstance(v, bool) == isinstance(k, bool)
    if pick == 3:
        return {"type": "integer", "multipleOf": 2}, lambda v: number(v) and v == int(v) and v % 2 == 0
    if pick == 4:
        n = draw.randrange(3)
        return {"minItems": n, "maxProperties": n}, lambda v: len(v) >= n if isinstance(v, list) else len(v) <= n if isinstance(v, dict) else True
    parts = [drawn(draw, depth - 1) for _ in range(draw.randrange(1, 4))]
    schemas, tests = [s for s, _ in parts], [t for _, t in parts]
    if pick == 5:
        return {"anyOf": schemas}, lambda v: any(t(v) for t in tests)
    if pick == 6:
        return {"oneOf": schemas}, lambda v: [bool(t(v)) for t in tests].count(True) == 1
    if pick == 7:
        return {"not": schemas[0], "allOf": schemas[1:]}, lambda v: not tests[0](v) and all(t(v) for t in tests[1:])
    names = "abc"[: len(parts)]
    need = draw.choice("abcd")
    return {"properties": dict(zip(names, schemas)), "required": [need], "items": schemas[0]}, lambda v: (need in v and all(t(v[n]) for n, t in zip(names, tests) if n in v)) if isinstance(v, dict) else all(map(tests[0], v)) if isinstance(v, list) else True


def value(draw, depth=3):
    pick = draw.randrange(8 if depth else 6)
    if pick < 6:
        return [draw.randrange(8), draw.randrange(5) + 0.5, "x" * draw.randrange(5), None, True, draw.choice(["a", 1.0])][pick]
    return [value(draw, depth - 1) for _ in range(draw.randrange(4))] if pick == 6 else {k: value(draw, depth - 1) for k in draw.sample("abcd", draw.randrange(5))}


def test_random_schemas_through_spark(spark):
    draw, rows, want = random.Random(5), [], {}
    for conv in range(300):
        schema, holds = drawn(draw)
        calls = [{k: value(draw) for k in draw.sample("abcd", draw.randrange(5))} for _ in range(4)]
        rows.append((conv, 0, "system", f"<tools>{json.dumps([{'name': 'f', 'parameters': schema}])}</tools>"))
        rows.append((conv, 1, "assistant", " ".join(f"<tool_call>{json.dumps({'id': f'c{k}', 'name': 'f', 'arguments': a})}</tool_call>" for k, a in enumerate(calls))))
        want[conv] = sum(not holds(a) for a in calls)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.n_invalid for r in toolcalls.format_turns(spark, frame).where("turn = 1").collect()} == want
    assert 200 < sum(want.values()) < 1000


def nested(n):
    return "[" * n + "]" * n


def test_no_turn_ends_the_job(spark):
    """Lone surrogates anywhere, nesting at and over the bound, numbers that JSON has not, texts of marks only."""
    call = lambda a, i="a", n="f": f'<tool_call>{{"id": "{i}", "name": "{n}", "arguments": {a}}}</tool_call>'
    texts = [call('{"x": "\\ud800"}'), call('{"\\udfff": 1}'), call("{}", i="\\ud800"), call("{}", n="\\ud800"), call('{"x": {"$result": "\\ud801"}}'), call(f'{{"x": {nested(toolcalls.DEPTH - 2)}}}'), call(f'{{"x": {nested(toolcalls.DEPTH)}}}'), call(f'{{"x": {nested(982)}}}'), call(f'{{"x": {nested(50_000)}}}')]
    texts += [call('{"x": NaN}'), call('{"x": 1e999}'), call('{"x": ' + "9" * 6000 + "}"), call("[1]"), "<tool_call></tool_call>", "<tool_call>", call('{"x": "\\u0000\\ud83d\\ude42"}')]
    texts += [f'<tool_result>{{"id": "a", "content": {c}}}</tool_result>' for c in ('"\\udc00"', nested(982), nested(50_000), "NaN")] + ['<tool_result>{"id": "\\ud800", "content": 1}</tool_result>']
    texts += [f'<tools>[{{"name": "f", "parameters": {{"const": {c}}}}}]</tools>' for c in ('"\\ud800"', nested(982), "NaN")] + ['<tools>[{"name": "\\ud800"}]</tools>']
    frame = spark.createDataFrame([(k, 0, "assistant", t) for k, t in enumerate(texts)] + [(k, 1, "tool", '{"tool_call_id": "a", "content": "\\ud800\\ud800"}') for k in range(3)], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in toolcalls.format_turns(spark, frame).collect()}
    assert len(got) == frame.count()
    first = json.loads(got[0, 0].message)["tool_calls"][0]
    assert first["arguments"] == {"x": "\ud800"} and first["error"] is None and first["result"] == "\ud800\ud800" and "\\ud800" in got[0, 0].message
    invalid = [got[k, 0].n_invalid for k in range(16)]
    assert invalid == [0, 0, 1, 1, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0] and got[14, 0].n_calls == 0
    assert json.loads(got[15, 0].message)["tool_calls"][0]["arguments"] == {"x": "\x00🙂"}
