"""The schema compiler against a plain validator."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from proofline.functions import schemas as S

SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["a", "b"],
    "properties": {
        "a": {"const": 1}, "c": {"enum": ["q", None, 2, True]}, "d": {"type": ["string", "null"], "minLength": 2, "maxLength": 4, "pattern": "^[a-z]+$"}, "e": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 9},
        "b": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "object", "additionalProperties": False, "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1, "maximum": 5}, "y": {"type": "array", "items": {"type": "string", "format": "date"}}}}},
    },
}


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "integer" if v == math.floor(v) else "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def plain(v, schema, path="$"):
    k, out, same = kind(v), [], lambda c: kind(c) == k and c == v
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types and k not in types and not (k == "integer" and "number" in types):
        out.append((path, "type"))
    if "const" in schema and not same(schema["const"]):
        out.append((path, "const"))
    if "enum" in schema and not any(map(same, schema["enum"])):
        out.append((path, "enum"))
    number, text = k in ("integer", "number"), k == "string"
    tests = {
        "minLength": lambda s: text and len(v) < s, "maxLength": lambda s: text and len(v) > s, "pattern": lambda s: text and not re.search(s, v), "format": lambda s: text and not re.search(S.FORMATS[s], v),
        "minimum": lambda s: number and v < s, "maximum": lambda s: number and v > s, "exclusiveMinimum": lambda s: number and v <= s, "exclusiveMaximum": lambda s: number and v >= s,
        "minItems": lambda s: k == "array" and len(v) < s, "maxItems": lambda s: k == "array" and len(v) > s, "uniqueItems": lambda s: k == "array" and len({json.dumps(x, sort_keys=True) for x in v}) < len(v),
    }
    out += [(path, n) for n, test in tests.items() if n in schema and test(schema[n])]
    if k == "array" and "items" in schema:
        out += [x for i, e in enumerate(v) for x in plain(e, schema["items"], f"{path}[{i}]")]
    if k == "object" and "properties" in schema:
        named = schema.get("properties", {})
        out += [(f"{path}.{n}", "required") for n in schema.get("required", ()) if n not in v]
        out += [(f"{path}.{n}", "additionalProperties") for n in v if n not in named]
        out += [x for n, e in v.items() if n in named for x in plain(e, named[n], f"{path}.{n}")]
    return out


def made(draw, depth=0):
    pick = draw.random()
    if depth > 3 or pick < 0.5:
        return draw.choice([None, True, False, 0, 1, 2, 5, 7, 1.5, -1, "q", "ab", "abcde", "A", "2024-01-31", "2024-13-01", 1.0])
    if pick < 0.7:
        return [made(draw, depth + 1) for _ in range(draw.randrange(5))]
    return {n: made(draw, depth + 1) for n in draw.sample("abcdexyz", draw.randrange(6))}


def test_violations_equal_a_plain_validator(spark):
    draw = random.Random(8)
    values = [{"a": 1, "b": [{"x": 1, "y": ["2024-01-31"]}]}, {"a": True, "b": [{"x": 2}, {"x": 2}]}]
    values += [{"a": draw.choice([1, 1.0, 2]), "b": [draw.choice([{"x": draw.choice([1, 9, 1.5, "1"]), "y": made(draw, 2)}, made(draw)]) for _ in range(draw.randrange(5))]} | {n: made(draw, 3) for n in draw.sample("cdef", 2)} for _ in range(150)]
    values += [made(draw) for _ in range(150)]
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, doc string")
    for r in rows.select("k", S.violations(F.col("doc"), SCHEMA).alias("v")).collect():
        assert sorted(map(tuple, r["v"])) == sorted(plain(values[r["k"]], SCHEMA)), json.dumps(values[r["k"]])


def test_no_python_and_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "nope"), (4, '{"a":1'), (5, "[]")], "k int, doc string").select("k", S.violations(F.col("doc"), SCHEMA).alias("v"))
    assert "Python" not in rows._jdf.queryExecution().toString()
    assert {r["k"]: r["v"] and [tuple(v) for v in r["v"]] for r in rows.collect()} == {1: None, 2: [("$", "not_json")], 3: [("$", "not_json")], 4: [("$", "not_json")], 5: [("$", "type")]}


@pytest.mark.parametrize("schema", [{"type": "object"}, {"type": "object", "additionalProperties": False, "properties": {"a": {"oneOf": []}}}, {"type": "array"}, {"type": "string", "format": "email"}])
def test_schemas_beyond_the_subset(schema):
    with pytest.raises(ValueError):
        S.check_schema(schema)
