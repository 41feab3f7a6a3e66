import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracewell.sources.strict_json import JsonError, nodes, parse, stable, verdicts, walk

BAD = {
    '{"a":1} x': ("JSON_SYNTAX", ""),
    '{"a":1,"\\u0061":2}': ("JSON_DUPLICATE_KEY", "/a"),
    '{"a":{"b/c":1,"b/c":2}}': ("JSON_DUPLICATE_KEY", "/a/b~1c"),
    '[{"__proto__":1}]': ("JSON_DANGEROUS_KEY", "/0/__proto__"),
    "1e999": ("JSON_NON_FINITE", ""),
    "{'a':1}": ("JSON_SYNTAX", ""),
    "[1,]": ("JSON_SYNTAX", "/1"),
    '{"a":01}': ("JSON_SYNTAX", ""),
    "": ("JSON_SYNTAX", ""),
    '"\t"': ("JSON_SYNTAX", ""),
    "NaN": ("JSON_SYNTAX", ""),
}
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4).filter(lambda k: k != "__proto__"), x, max_size=4), max_leaves=12)


@pytest.mark.parametrize("text", BAD)
def test_errors(text):
    with pytest.raises(JsonError) as e:
        parse(text)
    assert (e.value.code, e.value.pointer) == BAD[text]


def test_depth():
    assert parse("[" * 512 + "]" * 512)
    with pytest.raises(JsonError) as e:
        parse("[" * 513 + "]" * 513)
    assert e.value.code == "JSON_DEPTH"


@given(VALUES)
def test_round_trip(value):
    assert parse(json.dumps(value)) == value
    assert parse(stable(value)) == value


def test_stable():
    assert stable({"b": 1e2, "a": -0.0, "c": [1.5, None, True]}) == '{"a":0,"b":100,"c":[1.5,null,true]}'


def test_walk_order():
    assert [p for p, *_ in walk({"b": [1, {"x": 2}], "a/": 0})] == ["", "/a~1", "/b", "/b/0", "/b/1", "/b/1/x"]


def test_tables(spark):
    df = spark.createDataFrame([("k1", '{"a":[1,"x"]}'), ("k2", "{"), ("k3", None)], "record_key string, raw string")
    assert {(r.record_key, r.code) for r in verdicts(df).collect()} == {("k2", "JSON_SYNTAX"), ("k3", "JSON_SYNTAX")}
    assert [(r.pointer, r.kind, r.number, r.text) for r in nodes(df).orderBy("place").collect()] == [("", "object", None, None), ("/a", "array", None, None), ("/a/0", "number", 1.0, None), ("/a/1", "string", None, "x")]
