"""JSON documents held against closed schemas, as column expressions over VARIANT.

The subset: type (object, array, string, integer, number, boolean, null, or a list of them), const, enum, required,
properties with additionalProperties false, items, minItems, maxItems, uniqueItems, minLength,
maxLength, pattern, format (uuid, date, date-time, uri), minimum, maximum, exclusiveMinimum, exclusiveMaximum.
A schema is compiled once, on the driver, to an expression that gives the violations of a row
as an array; nothing runs in Python. Objects in arrays are checked element by element,
to any depth of the schema.

Defined results: a null document gives a null array; text that isn't JSON gives one violation
``not_json`` at the root; properties that a schema doesn't name are violations at their own path.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYWORDS = {
    "type", "const", "enum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "pattern", "format",
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "$schema", "$id", "title", "description",
}
FORMATS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "date": r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$",
    "date-time": r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])[Tt][0-2][0-9]:[0-5][0-9]:[0-6][0-9](?:\.[0-9]+)?(?:[Zz]|[+-][0-2][0-9]:[0-5][0-9])$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]*$",
}
_FOUND = "array<struct<path:string,rule:string>>"


def check_schema(schema: dict, path: str = "$") -> None:
    """Raises if a schema uses what the subset lacks, or leaves an object open."""
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"{path}: unsupported keywords {sorted(unknown)}")
    if schema.get("type") == "object" or "properties" in schema:
        if schema.get("additionalProperties") is not False:
            raise ValueError(f"{path}: an object must have additionalProperties false")
        for name, sub in schema.get("properties", {}).items():
            check_schema(sub, f"{path}.{name}")
    if schema.get("type") == "array" or "items" in schema:
        if not isinstance(schema.get("items"), dict):
            raise ValueError(f"{path}: an array must have an items schema")
        check_schema(schema["items"], f"{path}[]")
    if schema.get("format") not in (None, *FORMATS):
        raise ValueError(f"{path}: unsupported format {schema['format']}")


def _violation(path: Column, rule: str, broken: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def _kind(value: Column) -> Column:
    """object, array, string, integer, number, boolean or null."""
    kind = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "double")
    return (
        F.when(value.isNull() | (kind == "VOID"), "null").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when((kind == "BIGINT") | (whole == F.floor(whole)), "integer").otherwise("number")
    )


def _same(value: Column, kind: Column, constant) -> Column:
    if constant is None:
        return kind == "null"
    if isinstance(constant, bool):
        return (kind == "boolean") & (F.try_variant_get(value, "$", "boolean") == constant)
    if isinstance(constant, (int, float)):
        return kind.isin("integer", "number") & (F.try_variant_get(value, "$", "double") == float(constant))
    if isinstance(constant, str):
        return (kind == "string") & (F.try_variant_get(value, "$", "string") == constant)
    return F.to_json(value) == json.dumps(constant, separators=(",", ":"), sort_keys=True)


def _rules(schema: dict, value: Column, path: Column) -> Column:
    """The violations of a value that is there."""
    kind = _kind(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    found, deeper = [], []
    types = schema.get("type")
    types = [types] if isinstance(types, str) else types
    if types:
        allowed = [*types, "integer"] if "number" in types else types
        found.append(_violation(path, "type", ~kind.isin(*allowed)))
    if "const" in schema:
        found.append(_violation(path, "const", ~F.coalesce(_same(value, kind, schema["const"]), F.lit(False))))
    if "enum" in schema:
        any_ = F.lit(False)
        for constant in schema["enum"]:
            any_ = any_ | F.coalesce(_same(value, kind, constant), F.lit(False))
        found.append(_violation(path, "enum", ~any_))
    string, numeric, array, object_ = kind == "string", kind.isin("integer", "number"), kind == "array", kind == "object"
    tests = {
        "minLength": lambda v: string & (F.length(text) < v), "maxLength": lambda v: string & (F.length(text) > v), "pattern": lambda v: string & ~text.rlike(v), "format": lambda v: string & ~text.rlike(FORMATS[v]),
        "minimum": lambda v: numeric & (number < v), "maximum": lambda v: numeric & (number > v), "exclusiveMinimum": lambda v: numeric & (number <= v), "exclusiveMaximum": lambda v: numeric & (number >= v),
    }
    found += [_violation(path, name, test(schema[name])) for name, test in tests.items() if name in schema]
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        size = F.size(items)
        found += [_violation(path, n, array & b) for n, b in (("minItems", size < schema.get("minItems", 0)), ("maxItems", size > schema.get("maxItems", 1 << 30))) if n in schema]
        if schema.get("uniqueItems"):
            found.append(_violation(path, "uniqueItems", array & (F.size(F.array_distinct(F.transform(items, lambda v: F.to_json(v)))) < size)))
        inner = F.transform(items, lambda v, i: _rules(schema["items"], v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        deeper.append(F.when(array, F.flatten(inner)))
    if schema.get("type") == "object" or "properties" in schema:
        members = F.try_variant_get(value, "$", "map<string,variant>")
        keys = F.map_keys(members)
        named = schema.get("properties", {})
        under = lambda name: F.concat(path, F.lit("."), name)
        found += [_violation(under(F.lit(n)), "required", object_ & ~F.array_contains(keys, n)) for n in schema.get("required", ())]
        extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, named)) if named else F.array().cast("array<string>")))
        deeper.append(F.when(object_, F.transform(extra, lambda k: F.struct(under(k).alias("path"), F.lit("additionalProperties").alias("rule")))))
        for name, sub in named.items():
            deeper.append(F.when(object_ & F.array_contains(keys, name), _rules(sub, members[name], under(F.lit(name)))))
    none = F.array().cast(_FOUND)
    own = F.array_compact(F.array(*found)).cast(_FOUND) if found else none
    return F.concat(own, *[F.coalesce(d.cast(_FOUND), none) for d in deeper])


def violations(document: Column, schema: dict) -> Column:
    """array of struct(path, rule): how a JSON text breaks a schema, in the order of the schema; empty if it doesn't."""
    check_schema(schema)
    value = F.try_parse_json(document)
    bad = F.array(F.struct(F.lit("$").alias("path"), F.lit("not_json").alias("rule"))).cast(_FOUND)
    return F.when(document.isNotNull(), F.when(value.isNull(), bad).otherwise(_rules(schema, value, F.lit("$"))))
