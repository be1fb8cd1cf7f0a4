import random

import pytest
from brookloom.functions import structured as s


@pytest.mark.parametrize(
    "text,want",
    [("1+2*3", 7), ("-2^2", -4), ("2^3^2", 512), ("(1+2)*3", 9), ("7%4", 3), ("sqrt(16)+abs(-1)", 5), ("max(1,2,3)", 3), ("2*pi", 6.28318530718), ("0.1+0.2", 0.3), ("1/0", None), ("__import__('os')", None), ("1+", None), ("", None), ("(" * 500, None), ("2 3", None), ("9^9^9^9", None), ("(0-8)^0.5", None)],
)
def test_calculated(text, want):
    assert s.calculated(text) == want


def test_calculated_like_python():
    r = random.Random(1)
    for _ in range(200):
        e = str(r.randint(1, 9))
        for _ in range(r.randint(1, 6)):
            e = f"{e}{r.choice(['+', '-', '*'])}{r.choice(['', '('])}{r.randint(1, 9)}"
            e += ")" * (e.count("(") - e.count(")"))
        assert s.calculated(e) == float(f"{eval(e):.12g}")  # noqa: S307


def test_json():
    assert s.canonical('{"b": 1, "a": [1, 2]}') == '{"a":[1,2],"b":1}' and s.canonical("{") is None and s.canonical("NaN") is None
    assert s.inner_json('Sure:\n```json\n{"a": 1}\n```') == '{"a":1}' and s.inner_json('x {"a": {"b": 2}} y') == '{"a":{"b":2}}' and s.inner_json("none") is None
    assert s.inner_json('<think>{"no": 1}</think>[1]') == "[1]"


def test_schema(spark):
    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 1}, "t": {"type": "array", "items": {"type": "string", "maxLength": 2}, "uniqueItems": True}, "k": {"enum": ["a"]}}}
    assert s.schema_problems({"n": 0, "t": ["abc", "abc"], "k": "b", "x": 1}, schema) == ["$.n:minimum", "$.t:uniqueItems", "$.t[0]:maxLength", "$.t[1]:maxLength", "$.k:enum", "$.x:additional"]
    assert s.schema_problems({}, schema) == ["$.n:required"] and s.schema_problems([], schema) == ["$:type"] and s.schema_problems({"n": True}, schema) == ["$.n:type"]
    df = spark.createDataFrame([(1, '{"n": 1}'), (2, "{"), (3, None), (4, "{}")], "id long, body string")
    assert sorted(tuple(r) for r in s.schema_findings(df, "id", "body", schema).collect()) == [(2, "$:json"), (4, "$.n:required")]


def test_events():
    assert s.events(": hi\ndata: a\ndata:b\n\nevent: x\nid: 7\r\ndata: c\r\n\r\nevent: y\n\n") == [("message", "a\nb", None), ("x", "c", "7")]
    assert s.events("") == []


def test_fenced():
    text, got = s.fenced([("S1", "a>>>b" + "x" * 50), ("S2", "y" * 500), ("S3", "z")], 300, least=100)
    assert got == [0, 1] and len(text) <= 300 and text.count("<<end>>") == 2 and ">>>" not in text
    assert s.fenced([], 10) == ("", [])
