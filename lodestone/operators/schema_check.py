"""Documents against a contract (P22): a JSON schema walked over VARIANT values, and a round trip through typed columns.

A schema is walked once, on the driver, and becomes column expressions; documents are checked where they are.
Keywords: type, const, enum, required, properties, additionalProperties (false or a schema), items, minItems, maxItems,
minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern, anyOf, and $ref into the schema.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.validators import let

#: References inside references.
DEEPEST = 12
KNOWN = {
    "type", "const", "enum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
    "minLength", "maxLength", "pattern", "anyOf", "$ref", "$defs", "definitions", "$schema", "$id", "title", "description", "default", "examples", "$comment", "format",
}


def _none() -> Column:
    return F.array().cast("array<string>")


def _kind(v: Column) -> Column:
    """The JSON type of a variant; whole numbers are integers, whatever they are written like."""
    number = let(F.try_variant_get(v, "$", "double"), lambda n: F.when(n == F.floor(n), "integer").otherwise("number"))
    name = lambda found: (
        F.when(v.isNull(), None).when(found == "VOID", "null").when(found == "STRING", "string").when(found == "BOOLEAN", "boolean").when(found.startswith("OBJECT"), "object").when(found.startswith("ARRAY"), "array")
        .otherwise(number)
    )
    return let(F.schema_of_variant(v), name)


def _at(where: Column | None, step: Column) -> Column:
    return step if where is None else F.concat(where, F.lit("/"), step)


def _says(bad: Column, where: Column | None, text: str | Column) -> Column:
    """One message if ``bad`` holds, else none. An unknown truth counts as fine: another message tells why."""
    place = F.lit("<root>") if where is None else where
    return F.when(bad, F.array(F.concat(F.lit("schema["), place, F.lit("]: "), F.lit(text) if isinstance(text, str) else text))).otherwise(_none())


def _member(v: Column, key: str) -> Column:
    quote = "'" if "'" not in key else '"'
    if quote in key or "\\" in key:
        return F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))
    return F.try_variant_get(v, f"$[{quote}{key}{quote}]", "variant")


def _walk(v: Column, schema: dict, root: dict, where: Column | None, depth: int = 0) -> Column:
    if extra := sorted(set(schema) - KNOWN):
        raise ValueError(f"keywords {extra} aren't supported")
    if "$ref" in schema:
        if depth >= DEEPEST or not schema["$ref"].startswith("#/"):
            raise ValueError(f"{schema['$ref']} refers outside the schema, or to itself")
        there = root
        for step in schema["$ref"][2:].split("/"):
            there = there[step]
        return _walk(v, there, root, where, depth + 1)
    members = lambda kind: F.when(kind == "object", F.try_variant_get(v, "$", "map<string,variant>"))
    if not schema.keys() & {"required", "properties", "additionalProperties"}:
        return let(_kind(v), lambda kind: _rules(v, kind, None, None, schema, root, where, depth))
    return let(_kind(v), lambda kind: let(members(kind), lambda m: let(F.map_keys(m), lambda keys: _rules(v, kind, m, keys, schema, root, where, depth))))


def _rules(v: Column, kind: Column, members: Column | None, keys: Column | None, schema: dict, root: dict, where: Column | None, depth: int) -> Column:
    """What ``schema`` refuses about ``v``, of which its kind is known, and of an object its members and their names."""
    found: list[Column] = []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        fits = kind.isin(*kinds, *(["integer"] if "number" in kinds else []))
        found.append(_says(~fits, where, F.concat(F.lit("is "), kind, F.lit(f", not {' or '.join(kinds)}"))))
    if "const" in schema or "enum" in schema:
        allowed = [schema["const"]] if "const" in schema else schema["enum"]
        same = F.lit(False)
        for a in allowed:
            same = same | (F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(a))))) if a is not None else same | (kind == "null")
        found.append(_says(~same, where, f"is none of {json.dumps(allowed)}"))
    number = F.try_variant_get(v, "$", "double")
    is_number = kind.isin("integer", "number")
    for word, bad, text in (
        ("minimum", lambda b: number < b, "below"), ("maximum", lambda b: number > b, "above"), ("exclusiveMinimum", lambda b: number <= b, "not above"), ("exclusiveMaximum", lambda b: number >= b, "not below"),
    ):
        if word in schema:
            found.append(_says(is_number & bad(F.lit(float(schema[word]))), where, f"{text} {schema[word]}"))
    words = F.when(kind == "string", F.try_variant_get(v, "$", "string"))
    if "minLength" in schema:
        found.append(_says(F.length(words) < schema["minLength"], where, f"shorter than {schema['minLength']}"))
    if "maxLength" in schema:
        found.append(_says(F.length(words) > schema["maxLength"], where, f"longer than {schema['maxLength']}"))
    if "pattern" in schema:
        re.compile(schema["pattern"])
        found.append(_says(~words.rlike(schema["pattern"]), where, f"does not match {schema['pattern']}"))
    for name in schema.get("required", []):
        found.append(_says(~F.array_contains(keys, name), where, f"lacks {name}"))
    known = schema.get("properties", {})
    walked = lambda inner, there: lambda value: _walk(value, inner, root, there, depth)
    for name, inner in known.items():
        inside = let(_member(v, name), walked(inner, _at(where, F.lit(name))))
        found.append(F.when(F.array_contains(keys, name), inside).otherwise(_none()))
    rest = schema.get("additionalProperties", True)
    others = None if rest is True else F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)) if known else _none()))
    if rest is False:
        found.append(F.coalesce(F.flatten(F.transform(others, lambda k: _says(F.lit(True), where, F.concat(F.lit("does not know "), k)))), _none()))
    elif isinstance(rest, dict):
        inside = F.transform(others, lambda k: _walk(F.element_at(members, k), rest, root, _at(where, k), depth))
        found.append(F.coalesce(F.flatten(inside), _none()))
    if schema.keys() & {"minItems", "maxItems", "items"}:
        found.append(let(F.when(kind == "array", F.try_variant_get(v, "$", "array<variant>")), lambda items: _item_rules(items, schema, root, where, depth)))
    if "anyOf" in schema:
        fits = F.lit(False)
        for one in schema["anyOf"]:
            fits = fits | (F.size(_walk(v, one, root, where, depth)) == 0)
        found.append(_says(~fits, where, "fits none of the alternatives"))
    return F.concat(*found) if found else _none()


def _item_rules(items: Column, schema: dict, root: dict, where: Column | None, depth: int) -> Column:
    """What ``schema`` refuses about the number of ``items`` and about each; null, of what is no array, is fine."""
    found = []
    if "minItems" in schema:
        found.append(_says(F.size(items) < schema["minItems"], where, f"holds fewer than {schema['minItems']}"))
    if "maxItems" in schema:
        found.append(_says(F.size(items) > schema["maxItems"], where, f"holds more than {schema['maxItems']}"))
    if "items" in schema:
        inside = F.transform(items, lambda x, i: _walk(x, schema["items"], root, _at(where, i.cast("string")), depth))
        found.append(F.flatten(inside))
    return F.when(items.isNull(), _none()).otherwise(F.concat(*found))


def contract_report(rows: DataFrame, document: str, schema: dict, typed: str | None = None) -> DataFrame:
    """``rows`` with ``errors``, what the schema refuses, and ``warnings``, in the order of the schema's keywords and the
    documents' members; both empty: the document is fine.

    ``document`` holds JSON text. A null, text that is no JSON and a root that is no object are errors of their own. With
    ``typed``, a schema of Spark columns, documents without errors are read under it and written again: members whose
    value changes, and members it lacks, are one warning. Members that are absent, or null on both sides, don't
    count.
    """

    def errors(v: Column) -> Column:
        kind = _kind(v)
        whole = F.when(v.isNull(), F.array(F.lit("not a JSON document"))).when(kind != "object", F.array(F.concat(F.lit("document root must be an object, not "), kind)))
        return let(whole, lambda w: F.when(w.isNotNull(), w).otherwise(_walk(v, schema, schema, None)))

    out = rows.withColumn("errors", let(F.try_parse_json(document), errors))
    if typed is None:
        return out.withColumn("warnings", _none())
    names = [f.name for f in rows.sparkSession.createDataFrame([], typed).schema.fields]
    text = lambda x, name: F.nullif(F.to_json(_member(x, name)), F.lit("null"))

    def drift(v: Column, again: Column) -> Column:
        differs = lambda n: lambda was: F.when(was.isNotNull() & ~was.eqNullSafe(text(again, n)), F.lit(n))
        changed = [let(text(v, n), differs(n)) for n in names]
        unknown = F.array_except(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*map(F.lit, names)))
        return F.array_sort(F.concat(F.array_compact(F.array(*changed)), unknown))

    again = F.try_parse_json(F.to_json(F.from_json(document, typed), {"ignoreNullFields": "false"}))
    found = let(F.try_parse_json(document), lambda v: let(again, lambda a: drift(v, a)))
    warned = let(found, lambda f: F.when(F.size(f) > 0, F.array(F.concat(F.lit("re-serialisation drift on field(s): "), F.array_join(f, ", ")))).otherwise(_none()))
    return out.withColumn("warnings", F.when(F.size("errors") == 0, warned).otherwise(_none()))
