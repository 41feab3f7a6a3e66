"""Compiled schemas against the evaluator, on random documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import fact_columns, schema, schema_columns

SCHEMAS = {
    "http://s/a.json": {
        "$id": "http://s/a.json", "type": "object", "required": ["id", "a/b"], "minProperties": 2, "additionalProperties": {"type": ["string", "number", "null"]},
        "properties": {
            "id": {"$ref": "b.json#/$defs/Id"}, "n": {"type": "integer", "minimum": 0, "exclusiveMaximum": 9}, "q": {"oneOf": [{"const": 1}, {"const": 2.5}, {"type": "integer"}]}, "t": {"format": "date-time"}, "d": {"format": "date"},
            "u": {"format": "uri"}, "h": {"format": "hostname"}, "e": {"enum": ["x", 1, None, True]}, "l": {"type": "array", "uniqueItems": True, "contains": {"const": 3}, "minContains": 2, "prefixItems": [{"type": "string"}], "items": {"anyOf": [{"type": "integer"}, {"type": "object", "required": ["k"]}]}, "maxItems": 4, "minItems": 1},
            "no": False, "o": {"not": {"required": ["x"]}, "propertyNames": {"minLength": 2, "pattern": "^[a-z]"}, "additionalProperties": False, "patternProperties": {"^ab": {"type": "string"}}, "properties": {"x": True}},
        },
        "patternProperties": {"^p": {"maxLength": 2}}, "allOf": [{"if": {"required": ["n"]}, "then": {"required": ["q"]}, "else": {"properties": {"q": {"type": "string"}}}}],
    },
    "http://s/b.json": {"$id": "http://s/b.json", "$defs": {"Id": {"type": "string", "minLength": 5, "pattern": "^urn:"}}},
}
LEAVES = [["a", 3, "s", 3], "urn:x", "urn", "x", "ab", "2016-12-31T23:59:60Z", "2023-02-29T00:00:00Z", "2024-02-29", "2023-02-29", "2024-01-01t00:00:00.5+23:59", "http://a b", "a:b", "-x.y", "x.y-z", "日本", 0, 1, 2.5, 3, -1, 9, 8.5, True, False, None, [], {}, ["a", 3, 3], ["a", 3, {"k": 1}, 3.0, 5], [3], {"x": 1}, {"ab": 1, "abc": "s", "Z": 2}, {"a/b~c": 1}, 1e30, 12345678901234567890, "line\nbreak"]


def documents():
    r = random.Random(4)
    keys = ["id", "a/b", "n", "q", "t", "d", "u", "h", "e", "l", "no", "o", "p1", "other", "~x/y"]
    out = LEAVES + [{k: r.choice(LEAVES) for k in r.sample(keys, r.randrange(8))} for _ in range(250)]
    out += [{k: r.choice(LEAVES) for k in keys} for _ in range(60)]
    return [json.dumps(d, ensure_ascii=False) for d in out] + ['{"a":1,"a":2}', "{", '{"id":"urn:x"} 1', '{"id":"\\u0041"}']


def test_compiled_equals_evaluator(spark):
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(documents())] + [("none", None)], "record_key string, raw string")
    found = lambda d: sorted(map(tuple, d.collect()))
    want = found(schema.evaluated(rows, SCHEMAS, "http://s/a.json"))
    assert found(schema.validate(rows, SCHEMAS, "http://s/a.json")) == want
    assert {w[2] for w in want} >= {"type", "required", "minProperties", "oneOf", "format", "enum", "contains", "uniqueItems", "false", "not", "propertyNames", "additionalProperties", "maxLength", "anyOf", "minItems", "maxItems", "minimum", "exclusiveMaximum", "pattern", "minLength"}
    read = fact_columns.read(rows)
    assert read.where(fact_columns.plain(F.col("raw"), F.col("value"), words=False)).count() >= len(documents()) - 4


@pytest.mark.parametrize("odd", [{"$ref": "#"}, {"const": {"a": 1}}, {"pattern": "\\d"}, {"pattern": "(?i)x"}, {"unevaluatedProperties": False}])
def test_what_columns_cannot_say_is_left_to_the_evaluator(spark, odd):
    made = {"urn:s": {"$id": "urn:s", "properties": {"a": odd}}}
    with pytest.raises(schema_columns.Unsupported):
        schema_columns.Compiler(made).errors("urn:s", F.col("value"))
    rows = spark.createDataFrame([("1", '{"a":{"a":1}}')], "record_key string, raw string")
    assert sorted(map(tuple, schema.validate(rows, made, "urn:s").collect())) == sorted(map(tuple, schema.evaluated(rows, made, "urn:s").collect()))


def test_a_value_is_taken_once(spark):
    """However deep a schema goes, no level takes its value again for each keyword."""
    leaf = {"minItems": 1, "maxItems": 3, "items": {"properties": {"x": {"minimum": 1}, "y": {"minimum": 1}}, "required": ["z"]}}
    node = leaf
    for _ in range(5):
        node = {"properties": {"a": node}, "required": ["b"]}
    found = schema_columns.Compiler({"urn:s": {"$id": "urn:s", **node}}).errors("urn:s", F.col("value"))
    rows = spark.createDataFrame([("1", '{"b":1,"a":{}}')], "record_key string, raw string")
    plan = fact_columns.read(rows).select(found.alias("e"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_variant_get") < 40
    assert [tuple(e) for e in fact_columns.read(rows).select(found.alias("e")).first()[0]] == [("required", "/a/b")]


def test_plain_asks_for_the_parser_only_where_it_must(spark):
    """Digits after an e, or a ruled key's name, in a string are plain; numbers that may overflow, hidden depth and ruled keys are not."""
    deep = "[" * 600 + "1" + "]" * 600
    texts = {
        '{"id":"urn:e123"}': True, '{"a":"health"}': True, '{"a":"withheld"}': True, '{"a":1e999}': False, '{"a":["s",1e999]}': False, '{"a":%s}' % ("9" * 310): False,
        '{"health":{}}': False, '{"a":["s",{"freshness":{}}]}': False, '{"a":{"state":"withheld"}}': False, '{"a":["s",{"state":"deleted"}]}': False, '{"__proto__":1}': False, '{"a":"\\u0041"}': False, '{"a":["s",%s]}' % deep: False,
    }
    rows = fact_columns.read(spark.createDataFrame([(str(k), x) for k, x in enumerate(texts)], "record_key string, raw string"))
    got = {r.raw: r.p for r in rows.select("raw", fact_columns.plain(F.col("raw"), F.col("value")).alias("p")).collect()}
    assert got == texts


TYPED = {
    "urn:t": {
        "$id": "urn:t", "type": "object", "required": ["id", "any"], "propertyNames": {"maxLength": 5}, "allOf": [{"properties": {"id": {"minLength": 2}}}],
        "properties": {
            "id": {"pattern": "^u", "enum": ["ux", "u", "v"]}, "n": {"type": "integer", "maximum": 3}, "f": {"exclusiveMinimum": 0.5, "const": 2},
            "l": {"uniqueItems": True, "minItems": 1, "contains": {"required": ["k"]}, "items": {"required": ["k"], "properties": {"k": {"oneOf": [{"const": "a"}, {"maxLength": 1}]}, "s": {"items": {"format": "uri"}, "prefixItems": [{"minLength": 3}]}}}},
            "o": {"additionalProperties": False, "properties": {"x": {"minimum": 1}}, "if": {"required": ["x"]}, "then": {"required": ["y"]}, "else": {"not": {"required": ["z"]}}},
        },
    }
}


def typed_documents():
    """Most of the types that TYPED asks for; some with others, with nulls, or with strings that look like others."""
    r = random.Random(6)
    part = lambda: {k: v for k, v in (("k", r.choice(["a", "b", "", "long"])), ("s", [r.choice(["a:b", "x", "no uri", "http://x/"]) for _ in range(r.randrange(3))]), ("z", r.choice([1, 1.0, "1", {"b": 1, "a": 2}]))) if r.random() < 0.7}
    odd = [None, 5, "5", True, "true", [], {}, "[", "\u0041\u0007", 1e30, "null", {"a": None}]
    for _ in range(220):
        d = {"id": r.choice(["u", "ux", "w", "u\n"]), "any": r.choice(odd[1:] + ["x"] * 9), "n": r.choice([1, 2.0, 3.5, 9]), "f": r.choice([2, 2.0, 0.5, -1]), "l": [part() for _ in range(r.randrange(4))], "o": {k: r.choice([0, 1, 2]) for k in "xyz" if r.random() < 0.5}, "a/b~c": 1}
        d = {k: v for k, v in d.items() if r.random() < 0.85}
        if r.random() < 0.25 and d:
            d[r.choice(list(d))] = r.choice(odd)
        yield json.dumps(d, ensure_ascii=False)


@pytest.mark.parametrize("finding", ["f4", "f7"])
def test_schemas_of_one_type_a_place_are_judged_without_variant(spark, finding):
    """most records are read by one from_json(), and every record is told what the evaluator tells."""
    from tracewell.plans import corpus

    texts = [*typed_documents(), '{"id":"u","id":"u"}', '{"id":"u","any":1} 1', '{"any":1e999}', " {}", "[]", "null"]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)] + [("none", None)], "record_key string, raw string")
    schemas, own = (TYPED, "urn:t") if finding == "f4" else (corpus.RULED, "urn:ruled")
    if finding == "f7":
        made = corpus.records(spark, "/root/testdata/sf0.001").limit(300)
        rows = made.unionByName(rows)
    v = schema_columns.Typed(F.col("lean"), fact_columns.Need(), "$[0]")
    schema_columns.Compiler(schemas).found(own, v)
    columns, fit = fact_columns.taken(F.col("raw"), v, ["null"])
    assert rows.select("record_key", "raw", *[c.alias(n) for n, c in columns.items()]).where(fit).count() > (100 if finding == "f4" else 290)
    found = lambda d: sorted(map(tuple, d.collect()))
    want = found(schema.evaluated(rows, schemas, own))
    assert found(schema.validate(rows, schemas, own)) == want and len({w[2] for w in want}) > 7


def test_places_of_two_types_are_left_to_variant():
    for s in ({"type": ["string", "number"]}, {"const": True}, {"anyOf": [{"minLength": 1}, {"minimum": 1}]}, {"items": {"uniqueItems": True}}, {"properties": {"a": {}, "A": {"minimum": 1}, "a`": {"minimum": 1}}}):
        with pytest.raises(schema_columns.Unsupported):
            schema_columns.Compiler({"urn:s": {"$id": "urn:s", "properties": {"p": s}}}).found("urn:s", schema_columns.Typed(F.col("lean"), fact_columns.Need(), "$[0]"))
