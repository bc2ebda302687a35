import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import validate as val

SCHEMA = {
    "required": ["name", "value"],
    "properties": {
        "name": {"type": "string"},
        "value": {"type": "number"},
        "n": {"type": "integer"},
        "when": {"type": "string", "format": "date-time"},
        "mail": {"format": "email"},
        "odd": {"format": "no-such-format"},
        "host": {
            "type": "object",
            "required": ["id"],
            "properties": {
                "id": {"type": "string"},
                "list": {"type": "array", "items": {"type": "object", "required": ["k"],
                                                    "properties": {"k": {"type": "boolean"}}}},
            },
        },
        "tags": {"type": "array", "items": {"type": "string", "format": "uri"}},
        "loose": {"type": "array"},
    },
}
PII = ["user.email", "phone"]
OK = {"name": "a", "value": 1.5}
BAD_TYPE, BAD_VALUE = "invalid field type", "invalid field value"


def check(spark, docs, **how):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in docs]
    df = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)],
                               "id int, data binary")
    out = val.with_violation(df, **how).orderBy("id").collect()
    return [tuple(r.violation) if r.violation else None for r in out]


CASES = [
    (OK, None),
    ({"value": 1}, ("missing required field: name", "name")),
    ({"name": None, "value": 1}, (f"{BAD_TYPE}: expected string", "name")),
    ({"name": "a", "value": "1"}, (f"{BAD_TYPE}: expected number", "value")),
    ({}, ("missing required field: name", "name")),
    ("null", ("missing required field: name", "name")),
    ("[1]", (BAD_TYPE, "")),
    ('"x"', (BAD_TYPE, "")),
    ("7", (BAD_TYPE, "")),
    ('{"name":', ("failed to parse batch data", None)),
    ("{} {}", ("failed to parse batch data", None)),
    ("", ("failed to parse batch data", None)),
    ({**OK, "n": 3}, None),
    ('{"name":"a","value":1,"n":3.0}', None),
    ('{"name":"a","value":1,"n":1e3}', None),
    ('{"name":"a","value":1,"n":1.5e0}', (f"{BAD_TYPE}: expected integer", "n")),
    ('{"name":"a","value":1,"n":123456789012345678901234567890}', None),
    ({**OK, "n": True}, (f"{BAD_TYPE}: expected integer", "n")),
    ({**OK, "when": "2024-01-01T00:00:00Z"}, None),
    ({**OK, "when": "2024-01-01T00:00:00.123+02:00"}, None),
    ({**OK, "when": "2024-01-01T00:00:00Z\n"}, (f"{BAD_VALUE}: invalid date-time format", "when")),
    ({**OK, "when": "2024-01-01"}, (f"{BAD_VALUE}: invalid date-time format", "when")),
    ({**OK, "mail": "a@b"}, (f"{BAD_VALUE}: invalid email format", "mail")),
    ({**OK, "mail": 5}, (f"{BAD_TYPE}: format validation requires string", "mail")),
    ({**OK, "odd": "anything"}, None),
    ({**OK, "odd": None}, (f"{BAD_TYPE}: format validation requires string", "odd")),
    ({**OK, "host": {}}, ("missing required field: id", "host.id")),
    ({**OK, "host": {"id": 1}}, (f"{BAD_TYPE}: expected string", "host.id")),
    ({**OK, "host": []}, (f"{BAD_TYPE}: expected object", "host")),
    ({**OK, "host": {"id": "x", "list": [{"k": True}, {}]}},
     ("missing required field: k", "host.list[1].k")),
    ({**OK, "host": {"id": "x", "list": [{"k": 1}]}},
     (f"{BAD_TYPE}: expected boolean", "host.list[0].k")),
    ({**OK, "host": {"id": "x", "list": [7]}}, (f"{BAD_TYPE}: expected object", "host.list[0]")),
    ({**OK, "tags": ["http://a", "b", 3]}, (f"{BAD_VALUE}: invalid URI format", "tags[1]")),
    ({**OK, "tags": ["http://a", None]}, (f"{BAD_TYPE}: expected string", "tags[1]")),
    ({**OK, "tags": []}, None),
    ({**OK, "tags": {}}, (f"{BAD_TYPE}: expected array", "tags")),
    ({**OK, "loose": [1, "x", None]}, None),
    # Personal fields: literal dotted key, path, last part; any level that is checked.
    ({**OK, "user.email": "a@b.cc"}, ("PII field detected without hashing: user.email", "user.email")),
    ({**OK, "user": {"email": "a@b.cc"}}, ("PII field detected without hashing: user.email", "user.email")),
    ({**OK, "email": "a@b.cc"}, ("PII field detected without hashing: email", "email")),
    ({**OK, "email": "0" * 64}, None),
    ({**OK, "email": 5}, ("PII field detected without hashing: email", "email")),
    ({**OK, "phone": None}, ("PII field detected without hashing: phone", "phone")),
    ({**OK, "host": {"id": "x", "phone": "1 2"}},
     ("PII field detected without hashing: phone", "host.phone")),
    ({**OK, "host": {"id": "x", "list": [{"k": True, "phone": "1 2"}]}},
     ("PII field detected without hashing: phone", "host.list[0].phone")),
    # Order: required, then properties by name, then personal fields.
    ({"value": "x", "phone": "1 2"}, ("missing required field: name", "name")),
    ({**OK, "value": "x", "phone": "1 2", "n": 0.5}, (f"{BAD_TYPE}: expected integer", "n")),
]


def test_schema(spark):
    got = check(spark, [c[0] for c in CASES], schema=SCHEMA, pii_fields=PII)
    wrong = [(c[0], c[1], g) for c, g in zip(CASES, got) if c[1] != g]
    assert wrong == []


SIMPLE = [
    ({"a": {"b": {"c": None}}}, None),
    ({"a": {"b": {}}}, ("missing required field: a.b.c", "a.b.c")),
    ({"a": {}}, ("missing required field: a.b.c", "a.b.c")),
    ({"a": {"b": 5}}, (f"{BAD_TYPE}: b is not an object", "a.b.c")),
    ({"a": [1]}, (f"{BAD_TYPE}: a is not an object", "a.b.c")),
    ({"a": {"b": {"c": 1, "pw": "x"}}}, ("PII field detected without hashing: a.b.pw", "a.b.pw")),
    ({"a": {"b": {"c": 1, "pw": "abcd"}}}, None),
    ({"a": {"b": {"c": 1}}, "pw": "x"}, None),
    ("[]", (BAD_TYPE, "")),
]


def test_simple(spark):
    got = check(spark, [c[0] for c in SIMPLE], required=["a.b.c"], pii_fields=["a.b.pw"])
    assert got == [c[1] for c in SIMPLE]


def test_split_is_complete_and_says_why(spark):
    df = spark.createDataFrame([(1, '{"name":"a","value":1}'), (2, "{}"), (3, "{")], "id int, data string")
    valid, rejected = val.validate(df, SCHEMA)
    assert [r.id for r in valid.collect()] == [1] and valid.columns == ["id", "data"]
    got = {r.id: (r.error_code, r.error_message) for r in rejected.collect()}
    assert got == {
        2: ("ERR_INVALID_INPUT",
            "schema validation failed at path 'name': missing required field: name"),
        3: ("ERR_INVALID_INPUT", "failed to parse batch data"),
    }
    everything, nothing = val.validate(df, SCHEMA, enforce=False)
    assert everything.count() == 3 and nothing.count() == 0
    counts = val.validation_counts(val.with_violation(df, SCHEMA)).collect()
    assert {(r.reason, r.rows) for r in counts} == {
        ("", 1), ("missing required field: name", 1), ("failed to parse batch data", 1)
    }


@pytest.mark.parametrize("keep", ["violation is null", "violation is not null"])
def test_filters_do_not_parse_again(spark, keep):
    df = spark.createDataFrame([(1, "{}")], "id int, data string")
    out = val.with_violation(df, SCHEMA).filter(keep)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1


def test_custom_check(spark):
    def positive(doc):
        low = F.try_variant_get(doc, "$.value", "double") <= 0
        return F.when(low, F.struct(F.lit("not positive").alias("error"), F.lit("value").alias("path")))

    got = check(spark, [{"value": 1}, {"value": -1}, {}], schema={}, custom=[positive])
    assert got == [None, ("not positive", "value"), None]
