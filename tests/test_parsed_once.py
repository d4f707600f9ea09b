"""Documents are parsed once a check, however many rules look at them."""

from lodestone.operators import validators as V
from lodestone.operators.schema_check import contract_report
from lodestone.plans.files import CONTRACT


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson(")


def test_upload_problems_parse_a_document_once(spark):
    rows = spark.createDataFrame([('{"client_id": "a", "round": 1, "hparams": {"rank": "x"}}',)], "d string")
    out = rows.select(V.upload_problems(rows.d).alias("p"))
    assert out.first().p == ["rank must be a integer", "missing target_modules"]
    assert parses(out) == 1


def test_a_contract_parses_a_document_once_for_errors_and_once_for_the_round_trip(spark):
    rows = spark.createDataFrame([('{"client_id": "a", "round": -1, "hparams": {"rank": "x"}, "target_modules": ["q_proj", "x"]}',), ("[1]",), ("{",), (None,)], "d string")
    out = contract_report(rows, "d", CONTRACT, "client_id string, round int")
    assert [list(r.errors) for r in out.collect()] == [
        ["schema[round]: below 0", "schema[hparams/rank]: is string, not integer", 'schema[target_modules/1]: is none of ["q_proj", "v_proj"]'],
        ["document root must be an object, not array"], ["not a JSON document"], ["not a JSON document"],
    ]
    # the document for its errors, the document and its rewritten form for the warnings, two values of an enumeration
    assert parses(out.select("errors", "warnings")) <= 5
