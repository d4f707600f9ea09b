import json

import pytest

from lodestone.operators.schema_check import contract_report

SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "required": ["id", "hparams"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2, "maxLength": 8, "pattern": "^[a-z]"},
        "round": {"type": ["integer", "null"], "minimum": 0},
        "share": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1},
        "kind": {"enum": ["cluster", "client", None, 3]},
        "v": {"const": "1.0"},
        "hparams": {"$ref": "#/$defs/hparams"},
        "clients": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "maximum": 9}}}},
        "extra": {"type": "object", "additionalProperties": {"type": "boolean"}},
        "either": {"anyOf": [{"type": "string"}, {"type": "integer", "minimum": 5}]},
        "it's": {"type": "string"},
    },
    "$defs": {"hparams": {"type": "object", "required": ["rank"], "properties": {"rank": {"type": "integer"}}}},
}
FINE = {"id": "ab", "hparams": {"rank": 4}}


def errors(spark, documents, schema=SCHEMA, typed=None):
    rows = spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "i int, d string")
    return [(r.errors, r.warnings) for r in contract_report(rows, "d", schema, typed).orderBy("i").collect()]


def test_documents_that_fit(spark):
    fine = [
        FINE, FINE | {"round": None}, FINE | {"round": 3.0}, FINE | {"share": 0.5, "kind": None}, FINE | {"kind": 3, "v": "1.0"}, FINE | {"clients": [{"n": 9, "more": [1]}]},
        FINE | {"extra": {}}, FINE | {"extra": {"a": True}}, FINE | {"either": "x"}, FINE | {"either": 5}, FINE | {"it's": "ok"},
    ]
    assert errors(spark, fine) == [([], [])] * len(fine)


WRONG = [
    (None, ["not a JSON document"]),
    ("{", ["not a JSON document"]),
    ("[1]", ["document root must be an object, not array"]),
    ("3", ["document root must be an object, not integer"]),
    ({}, ["schema[<root>]: lacks id", "schema[<root>]: lacks hparams"]),
    ({"id": 5, "hparams": None}, ["schema[id]: is integer, not string", "schema[hparams]: is null, not object"]),
    (FINE | {"id": "a"}, ["schema[id]: shorter than 2"]),
    (FINE | {"id": "9abcdefghi"}, ["schema[id]: longer than 8", "schema[id]: does not match ^[a-z]"]),
    (FINE | {"round": -1}, ["schema[round]: below 0"]),
    (FINE | {"round": 1.5}, ["schema[round]: is number, not integer or null"]),
    (FINE | {"share": 1}, ["schema[share]: not below 1"]),
    (FINE | {"share": 0}, ["schema[share]: not above 0"]),
    (FINE | {"kind": "web"}, ['schema[kind]: is none of ["cluster", "client", null, 3]']),
    (FINE | {"v": 1.0}, ['schema[v]: is none of ["1.0"]']),
    (FINE | {"b": 1, "a": 2}, ["schema[<root>]: does not know a", "schema[<root>]: does not know b"]),
    (FINE | {"hparams": {}}, ["schema[hparams]: lacks rank"]),
    (FINE | {"hparams": {"rank": "4"}}, ["schema[hparams/rank]: is string, not integer"]),
    (FINE | {"clients": []}, ["schema[clients]: holds fewer than 1"]),
    (FINE | {"clients": [{"n": 1}, {"n": 10}, {}, 7]}, ["schema[clients]: holds more than 3", "schema[clients/1/n]: above 9", "schema[clients/2]: lacks n", "schema[clients/3]: is integer, not object"]),
    (FINE | {"extra": {"b": 1, "a": False}}, ["schema[extra/b]: is integer, not boolean"]),
    (FINE | {"either": 4}, ["schema[either]: fits none of the alternatives"]),
    (FINE | {"it's": 1}, ["schema[it's]: is integer, not string"]),
]


def test_documents_that_do_not_fit(spark):
    got = errors(spark, [d for d, _ in WRONG])
    assert [(d, e) for (d, _), (e, _) in zip(WRONG, got, strict=True)] == WRONG and not any(w for _, w in got)


def test_round_trip_warnings(spark):
    typed = "id string, round int, hparams struct<rank:int>, tags array<string>"
    loose = {"type": "object", "required": ["id"]}
    documents = [
        FINE, {"id": "a", "round": 1.5}, {"id": "a", "round": None}, {"id": "a", "hparams": {"rank": 4, "alpha": 8}}, {"id": "a", "zeta": 1, "beta": None}, {"id": "a", "tags": ["x", "y"]}, {"round": "x"},
    ]
    got = errors(spark, documents, loose, typed)
    drift = lambda *names: ([], ["re-serialisation drift on field(s): " + ", ".join(names)])
    assert got == [([], []), drift("round"), ([], []), drift("hparams"), drift("beta", "zeta"), ([], []), (["schema[<root>]: lacks id"], [])]


def test_schemas_that_are_refused(spark):
    for bad, text in (({"oneOf": []}, "aren't supported"), ({"$ref": "#/x", "x": {}}, "aren't supported|refers"), ({"$ref": "http://a"}, "refers outside"), ({"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}}, "to itself")):
        with pytest.raises(ValueError, match=text):
            errors(spark, [{}], bad)
