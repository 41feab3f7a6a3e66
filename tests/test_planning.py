import json

import pytest

from tracewell.operators import records as rec
from tracewell.operators import registry_checks
from tracewell.plans import processing

from .test_records import BASE, WORDS


def test_registry(spark):
    rows = [("a", True, "b", "subject"), ("b", True, "a", "object"), ("c", True, "d", "subject"), ("d", True, "c", "subject"), ("e", False, "a", None), ("f", True, "zz", None), ("f", True, None, None)]
    df = spark.createDataFrame(rows, registry_checks.SCHEMA)
    got = {(r.id, r.code.removeprefix("REGISTRY_")) for r in registry_checks.findings(df).collect()}
    assert got == {("c", "INVERSE_SAME_DIRECTION"), ("d", "INVERSE_SAME_DIRECTION"), ("e", "INVERSE_NOT_RECIPROCAL"), ("f", "INVERSE_UNKNOWN"), ("f", "DUPLICATE_ID")}
    placed = spark.createDataFrame([(*r, k) for k, r in enumerate(rows[:4])], registry_checks.SCHEMA + ", place int")
    assert {(r.predicate, r.canonical, r.reverse) for r in registry_checks.orientations(placed).collect()} == {("a", "a", False), ("b", "a", True), ("c", "c", False), ("d", "c", True)}


def test_built_in_registry_is_what_compilation_gives(spark):
    rows = []
    other = {name: inverse for name, _, inverse in rec.ACYCLIC if inverse}
    other |= {v: k for k, v in other.items()}
    for k, (name, _, _) in enumerate(rec.ACYCLIC):
        rows.append((f"ns:{name}", True, f"ns:{other[name]}" if name in other else None, None, k))
    got = {(r.predicate, r.reverse) for r in registry_checks.orientations(spark.createDataFrame(rows, registry_checks.SCHEMA + ", place int")).collect()}
    assert got == {(r.predicate, r.reverse) for r in rec.registry(spark, WORDS).collect()}


def test_requests(spark):
    r = processing.request(WORDS, "granulate", ["urn:p", "urn:a"], {})
    assert r["operationType"] == "op.granulate" and r["outputContract"]["maxOutputs"] == 16
    for bad in (("mix", ["x"]), ("reduce", [])):
        with pytest.raises(processing.PlanError):
            processing.request(WORDS, *bad, {})
    facts = rec.facts(spark.createDataFrame([("k", json.dumps(BASE))], "record_key string, raw string"), WORDS)
    wanted = spark.createDataFrame([("k", n, x) for n, x in enumerate(r["inputs"])], "record_key string, place int, id string")
    assert [tuple(x) for x in processing.unresolved_inputs(facts, wanted).collect()] == [("k", "UNRESOLVED_REF", "/inputs/1")]


def test_artifact_status(spark):
    v = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "record_key string, valid boolean")
    d = spark.createDataFrame([("a", ["core"]), ("b", ["core"])], "record_key string, profiles array<string>")
    assert {tuple(r) for r in processing.artifact_status(v, d, "reader").collect()} == {("a", "partial"), ("b", "failed"), ("c", "failed")}
