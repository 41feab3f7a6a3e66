import copy
import json
import random

import pytest

from tracewell.operators import public, records as rec
from tracewell.operators.profiles import mismatches
from tracewell.operators.schema import Catalog
from tracewell.plans import validation

WORDS = rec.Vocabulary("ns", "op")
BASE = {
    "id": "urn:r", "createdBy": "urn:a", "profiles": ["core"], "actors": [{"id": "urn:a"}],
    "representations": [{"id": "urn:p"}, {"id": "urn:q"}],
    "relations": [{"id": "urn:x", "predicate": "ns:derived-from", "subject": "urn:q", "object": "urn:p", "assertedBy": "urn:a", "operationRef": "urn:e"}],
    "history": {"mode": "embedded", "events": [{"id": "urn:e", "recordId": "urn:r", "sequence": 0, "effectClass": "transform", "finalStatus": "completed", "inputs": ["urn:p"], "outputs": ["urn:q"], "policyEvaluation": {"result": "permitted"}}]},
}


def event(d):
    return d["history"]["events"][0]


MUTATIONS = {
    "sound": (lambda d: None, set()),
    "duplicate": (lambda d: d["representations"].append({"id": "urn:a"}), {"DUPLICATE_ID"}),
    "dangling": (lambda d: d.update(createdBy="urn:z"), {"UNRESOLVED_REF"}),
    "typed": (lambda d: d.update(createdBy="urn:p"), {"REF_TYPE"}),
    "cycle": (lambda d: d["relations"].append(d["relations"][0] | {"id": "urn:y", "subject": "urn:p", "object": "urn:q"}), {"DERIVATION_CYCLE"}),
    "denied": (lambda d: event(d).pop("policyEvaluation"), {"POLICY_DENIED"}),
    "other record": (lambda d: event(d).update(recordId="urn:o"), {"UNRESOLVED_REF"}),
    "sequence": (lambda d: event(d).update(sequence=1.5), {"EVENT_SEQUENCE"}),
    "ends first": (lambda d: event(d).update(startedAt="2024-01-02T00:00:00Z", endedAt="2024-01-01T00:00:00Z"), {"EVENT_SEQUENCE"}),
    "leap second": (lambda d: event(d).update(startedAt="2016-12-31T23:59:60Z", endedAt="2016-01-01T00:00:00Z"), set()),
    "no receipt": (lambda d: d["relations"][0].pop("operationRef"), {"DESCENDANT_RECEIPT"}),
    "itself": (lambda d: event(d).update(outputs=["urn:p"]), {"DESCENDANT_REUSES_INPUT", "DESCENDANT_RECEIPT"}),
    "window": (lambda d: d.update(claims=[{"id": "urn:c", "window": {"start": 2, "end": 1}}]), {"WINDOW_ORDER"}),
    "policy times": (lambda d: d.update(policies=[{"id": "urn:l", "validFrom": "2024-02-01T00:00:00Z", "validUntil": "2024-01-01T00:00:00Z"}]), {"TEMPORAL_ORDER"}),
    "health": (lambda d: d.update(sources=[{"id": "urn:s", "health": {"status": "error"}}]), {"STATE_REASON_MISSING"}),
    "withheld": (lambda d: d.update(title={"state": "withheld", "policyRefs": ["urn:none"]}), {"UNRESOLVED_REF"}),
    "extension relation": (lambda d: d["relations"].append({"id": "urn:y", "predicate": "other:derived-from", "subject": "urn:p", "object": "urn:q"}), set()),
    "profile": (lambda d: d.update(profiles=["core", "audio"]), {"PROFILE_MISMATCH"}),
}


def test_each_mutation_has_its_code(spark):
    rows = []
    for name, (change, _) in MUTATIONS.items():
        d = copy.deepcopy(BASE)
        change(d)
        rows.append((name, json.dumps(d)))
    rows.append(("broken", '{"a":1,"a":2}'))
    df = spark.createDataFrame(rows, "record_key string, raw string")
    found: dict = {}
    for r in validation.diagnose(df, WORDS).collect():
        found.setdefault(r.record_key, set()).add(r.code)
    expected = {k: c for k, (_, c) in MUTATIONS.items() if c} | {"broken": {"JSON_DUPLICATE_KEY"}}
    assert found == expected
    valid = {r.record_key for r in validation.verdicts(df, WORDS).collect() if r.valid}
    assert valid == {k for k, (_, c) in MUTATIONS.items() if not c} | {"health"}


def test_long_chain_does_not_exhaust_the_stack():
    edges = [(f"n{k}", f"n{k + 1}", f"/relations/{k}") for k in range(30_000)]
    assert rec.back_edges(edges) == []
    assert rec.back_edges([*edges, ("n30000", "n0", "/last")]) == ["/last"]


def test_strings_are_counted_after_filtering():
    assert list(rec.expand({"a": [{"r": [1, "x", None, "y"]}]}, "a[].r[]")) == [("/a/0/r/0", "x"), ("/a/0/r/1", "y")]


PUBLIC = BASE | {
    "disclosure": "private", "integrity": {"state": "known"}, "type": "ns:Record", "schemaVersion": "1", "formatVersion": "0.2.0",
    "extensions": {"ok:a": 1, "no:b": 2}, "actors": [{"id": "urn:a", "disclosure": "public", "password": "x"}, {"id": "urn:b", "disclosure": "private"}],
    "representations": [{"id": "urn:p", "disclosure": "public", "role": "preview", "availability": "available", "locator": {"state": "known", "value": "/home/me/x.wav"}}],
    "policies": [{"id": "urn:l", "status": "active", "disclosure": "public", "rules": [{"id": "urn:u", "effect": "permission", "actions": ["publish"], "targets": ["urn:r"], "authorityBasis": {"state": "known"}}]}],
    "publication": {"publicRecordId": "urn:pub", "approvedAt": "2024-01-01T00:00:00Z", "approvedBy": "urn:a", "approvedExtensionNamespaces": ["ok:"], "policyEvaluation": {"result": "permitted", "action": "publish", "targets": ["urn:r"], "policyRefs": ["urn:l"], "authorityRefs": ["urn:u"]}},
}


def test_projection_is_public():
    out = public.project(PUBLIC, WORDS)
    assert public.audit(out, WORDS) == []
    assert out["id"] == "urn:pub" and "urn:r" not in json.dumps(out)
    assert out["extensions"] == {"ok:a": 1} and len(out["actors"]) == 1 and "password" not in out["actors"][0]
    assert out["representations"][0]["locator"]["state"] == "unavailable"
    assert {"/actors/1", "/relations/0", "/extensions/no:b", "/history/events/0"} <= {o["pointer"] for o in out["publication"]["omissions"]}
    assert public.project(PUBLIC, WORDS, {"urn:x"})["relations"][0]["id"] == "urn:x"


@pytest.mark.parametrize(
    ("value", "code"),
    [("/etc/passwd", "PUBLIC_PATH"), ("AKIA" + "A" * 16, "PUBLIC_SECRET"), ("https://u:p@a.org/", "PUBLIC_SECRET"), ("https://a.org/?sig=1", "PUBLIC_SECRET"), ("http://127.1/x", "PUBLIC_PRIVATE_ENDPOINT"), ("https://box.local/", "PUBLIC_PRIVATE_ENDPOINT")],
)
def test_audit_of_strings(value, code):
    assert (code, "/title") in public.audit(public.project(PUBLIC, WORDS) | {"title": value}, WORDS)


def test_audit_of_places_and_policies():
    out = public.project(PUBLIC, WORDS)
    assert ("PUBLIC_PRECISE_LOCATION", "/scales/lat") in public.audit(out | {"scales": {"lat": "51.5"}}, WORDS)
    assert ("PUBLIC_PRECISE_LOCATION", "/scales/coordinates") in public.audit(out | {"scales": {"coordinates": [["x", [1]]]}}, WORDS)
    no = copy.deepcopy(out)
    no["policies"][0]["rules"].append({"effect": "prohibition", "actions": ["op.publish"], "targets": ["urn:a"]})
    assert ("POLICY_DENIED", "/policies/0/rules/1") in public.audit(no, WORDS)
    no["policies"][0]["status"] = "retired"
    assert ("POLICY_DENIED", "/publication/policyEvaluation/policyRefs/0") in public.audit(no, WORDS)


def test_projection_needs_a_publication(spark):
    df = spark.createDataFrame([("a", json.dumps(BASE)), ("b", json.dumps(PUBLIC)), ("c", "[")], "record_key string, raw string")
    got = {r.record_key: (r.code, len(r.findings)) for r in public.projections(df, WORDS).collect()}
    assert got == {"a": ("PUBLICATION_REQUIRED", 0), "b": (None, 0), "c": ("JSON_SYNTAX", 0)}


def test_profiles():
    assert mismatches({"profiles": ["core", "agent", "x"]}, WORDS) == [("x", -1), ("agent", 0), ("agent", 1), ("agent", 2)]
    r = {"profiles": ["core", "processing"], "history": {"mode": "embedded", "events": [{"operationType": "op.granulate", "effectClass": "derive", "finalStatus": "completed", "outputs": ["x"]}]}}
    assert mismatches(r, WORDS) == [("processing", 1)]
    r |= {"representations": [{}, {}], "relations": [{"predicate": "ns:granulated-from", "operationRef": "e"}]}
    assert mismatches(r, WORDS) == []


def test_schema():
    c = Catalog({
        "http://s/a.json": {"$id": "http://s/a.json", "type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"$ref": "b.json#/$defs/Id"}, "n": {"type": "integer", "minimum": 0}, "q": {"oneOf": [{"const": 1}, {"const": 2}]}, "t": {"format": "date-time"}, "l": {"type": "array", "uniqueItems": True, "contains": {"const": 3}, "prefixItems": [{"type": "string"}]}}, "if": {"required": ["n"]}, "then": {"required": ["q"]}},
        "http://s/b.json": {"$id": "http://s/b.json", "$defs": {"Id": {"type": "string", "minLength": 5, "pattern": "^urn:"}}},
    })
    e = lambda v: c.errors("http://s/a.json", v)
    assert e({"id": "urn:x", "n": 1, "q": 2, "t": "2016-12-31T23:59:60Z", "l": ["a", 3]}) == []
    assert e({"id": "ur", "n": 1.5, "x": 1}) == [("additionalProperties", "/x"), ("minLength", "/id"), ("pattern", "/id"), ("required", "/q"), ("type", "/n")]
    assert e({"n": -1, "q": 3, "t": "x", "l": [1, 1]}) == [("contains", "/l"), ("format", "/t"), ("minimum", "/n"), ("oneOf", "/q"), ("required", "/id"), ("type", "/l/0"), ("uniqueItems", "/l")]


def test_summary_counts_items_with_or_without_ids(spark):
    rows = [("a", json.dumps({"actors": [{"id": "x"}, {"id": "x"}, {}], "xVersion": "9", "formatVersion": "2", "revision": 3, "profiles": ["core"]})), ("b", "{}"), ("c", "[")]
    got = {r.record_key: r for r in rec.summary(rec.facts(spark.createDataFrame(rows, "record_key string, raw string"), WORDS)).collect()}
    assert set(got) == {"a", "b"} and (got["a"].actors, got["a"].duplicate_ids, got["a"].version, got["a"].revision, got["a"].profiles) == (3, 1, "2", 3, ["core"])
    assert (got["b"].actors, got["b"].duplicate_ids, got["b"].id) == (0, 0, "")


def test_the_first_receipt_of_an_id_counts(spark):
    d = copy.deepcopy(BASE)
    d["history"]["events"].insert(0, event(d) | {"inputs": [], "outputs": []})
    event(d)["sequence"], d["history"]["events"][1]["sequence"] = 0, 1
    rows = spark.createDataFrame([("a", json.dumps(d))], "record_key string, raw string")
    assert {r.code for r in rec.semantics(rows, WORDS).collect()} == {"DUPLICATE_ID"}
    d["history"]["events"].reverse()
    event(d)["sequence"], d["history"]["events"][1]["sequence"] = 0, 1
    event(d)["inputs"] = []
    rows = spark.createDataFrame([("a", json.dumps(d))], "record_key string, raw string")
    assert "DESCENDANT_RECEIPT" in {r.code for r in rec.semantics(rows, WORDS).collect()}


TEXTS = ['{"id":"x"}', ' {"id":"x"}\n', '{"id":"x"} 1', '{"id":"x"}]', '{"id":"x"}}', '{"id":"x"},7]', '{"id":"x"},"k":1', '{"id":"x","id":"y"}', '{"__proto__":1}', '{"\\u005f_proto__":1}', '{"revision":1e999}', '{"revision":' + "9" * 320 + "}", '{"a":' * 513 + "1" + "}" * 513, "[" * 600 + "]" * 600, "{", "", "null", "[1]", '"x"', '{"title":{"state":"withheld","policyRefs":["p"]}}', "﻿{}", '{"a":01}', '{"a":"\t"}']


def scrambled(r: random.Random, value, depth=0):
    """value with some parts replaced by values of other types, dropped, or repeated."""
    if r.random() < 0.04:
        return r.choice([None, True, 3, 2.5, -0.0, 1e30, "x", "", [], {}, ["a", 1, None, "b"], {"id": "z"}, 12345678901234567890])
    if isinstance(value, dict):
        return {k: scrambled(r, v, depth + 1) for k, v in value.items() if r.random() > 0.05}
    if isinstance(value, list):
        out = [scrambled(r, v, depth + 1) for v in value if r.random() > 0.05]
        return out + [r.choice(out)] if out and r.random() < 0.2 else out
    return value


FULL = BASE | {
    "type": "ns:Record", "disclosure": "public", "revision": 3, "formatVersion": "0.2.0",
    "sources": [{"id": "urn:s", "policyRefs": ["urn:l"], "causalClaimRefs": ["urn:c"]}], "encounters": [{"id": "urn:n", "actors": ["urn:a"], "contextRefs": ["urn:t"]}],
    "apertures": [{"id": "urn:w", "ranges": [{"start": 1, "end": 2}, 5], "windows": [{"start": 2, "end": 1.5}]}], "observations": [{"id": "urn:o", "sourceRef": "urn:s", "method": {"apparatusRefs": ["urn:s", 4, "urn:q"]}}],
    "claims": [{"id": "urn:c", "about": ["urn:p"], "actor": "urn:a", "window": {"start": 3, "end": 2}, "basis": [{"role": "source", "ref": "urn:s"}, {"role": "external", "ref": "u"}, {"role": "odd", "ref": "v"}, {"ref": "w"}]}],
    "measurements": [{"id": "urn:m", "about": "urn:p", "window": {"start": 0, "end": 0}}], "mappings": [{"id": "urn:g", "sourceObservationRefs": ["urn:o"]}], "contexts": [{"id": "urn:t"}],
    "policies": [{"id": "urn:l", "issuer": "urn:a", "validFrom": "2024-01-01T00:00:00Z", "validUntil": "2025-01-01T00:00:00Z", "rules": [{"id": "urn:u", "type": "r", "targets": ["urn:p"], "subjects": ["urn:a"]}]}],
    "agentRuns": [{"id": "urn:v", "actorRef": "urn:a", "operationRefs": ["urn:e"]}], "publication": {"publicRecordId": "urn:pub", "approvedBy": "urn:a", "policyEvaluation": {"policyRefs": ["urn:l"], "authorityRefs": ["urn:u"], "evaluator": "urn:a", "targets": ["urn:r"]}},
    "relations": [*BASE["relations"], {"id": "urn:y", "predicate": "ns:has-part", "subject": "urn:p", "object": "urn:q", "basis": [{"role": "operation", "ref": "urn:e"}]}, {"predicate": "x:y", "subject": "urn:p", "object": "urn:q"}],
    "history": {"mode": "embedded", "eventIds": ["urn:1", 2], "events": [
        event(BASE) | {"actors": ["urn:a"], "claimRefs": ["urn:c"], "startedAt": "a", "endedAt": "b", "effectClass": "generate", "parameters": {"parentRefs": ["urn:p"], "regionRefs": ["urn:q", 1, "urn:z"]}},
        event(BASE) | {"id": "urn:f", "operationType": "op.granulate", "parameters": {"regionRefs": ["urn:p"], "selection": {"regionRefs": ["urn:q"]}}, "sequence": 1.5},
    ]},
}


PARAMETERS = {
    "granulate": {"grain": {"durationMs": {"min": 1, "max": 2}, "envelope": "custom", "panScatter": 0.5}, "emission": {"mode": "custom", "grainsPerSecond": 3}, "selection": {"order": "linear", "regionRefs": ["urn:p"]}, "output": {"kind": "texture"}, "more": 1},
    "extract": {"domain": "partials", "partials": {"count": 2, "criterion": "loudest"}, "residual": True}, "reduce": {"kind": "mixdown", "factor": 2}, "fragment": {"strategy": "grains", "count": 2},
    "timestretch": {"factor": 0.5, "transientMode": "smear"}, "pitchshift": {"cents": -100},
    "generate": dict.fromkeys(["generationMethod", "parentRefs", "conditioningRefs", "regionRefs", "prompt", "negativePrompt", "model", "adapter", "provider", "providerPolicyState", "selection", "rejectedOutputRefs"], ["urn:p"]),
    "segment": {"preservationIntent": "x"},
}


def profiled(kind):
    effect = "generate" if kind == "generate" else "transform"
    done = event(BASE) | {"operationType": f"op.{kind}", "effectClass": effect, "parameters": PARAMETERS[kind]}
    shown = event(BASE) | {"operationType": "op.publish", "effectClass": "publish", "reversibility": "irreversible", "sequence": 1}
    return FULL | {
        "profiles": ["core", "audio", "listening", "analysis", "transformation", "generation", "processing", "observation", "mapping", "agent", "publication", "odd", "processing"],
        "representations": [{"id": "urn:p", "mediaType": "audio/wav", "audio": {}}, {"id": "urn:q"}], "actors": [{"id": "urn:a", "actorKind": "agent"}], "capabilities": [{"id": "urn:b"}], "listeningPasses": [{"id": "urn:k"}],
        "observations": [FULL["observations"][0] | dict.fromkeys(["epistemicStatus", "temporalCharacter", "signalKind"], "x")], "history": {"mode": "embedded", "events": [done, shown]},
        "publication": FULL["publication"] | {"policyEvaluation": {"result": "permitted"}},
    }


def test_profiles_of_whole_records():
    for kind in PARAMETERS:
        mine = {"segment": "transformation", "generate": "generation"}.get(kind, "processing")
        failed = {p for p, _ in mismatches(profiled(kind), WORDS)}
        assert failed == {"odd", "transformation", "generation", "processing"} - {mine}
        for change in ({"kind": 1}, {"factor": 0}, {"grain": 1}, {"domain": "x"}, {"strategy": None}, {"cents": 14401}, {"domain": "temporal-region", "regionRefs": []}):
            d = copy.deepcopy(profiled(kind))
            d["history"]["events"][0]["parameters"] |= change
            bad = {"granulate": "grain", "extract": "domain", "reduce": "kind", "fragment": "strategy", "timestretch": "factor", "pitchshift": "cents"}.get(kind)
            hit = bad in change or kind == "reduce" and "factor" in change or kind == "fragment" and change.get("regionRefs") == ["x"]
            assert ("processing", 0) in mismatches(d, WORDS) if hit or mine != "processing" else ("processing", 0) not in mismatches(d, WORDS), (kind, change)


def test_column_facts_equal_the_parsers(spark):
    """Sound, broken and scrambled records: columns tell what the strict parser tells, or leave the text to it."""
    r = random.Random(9)
    docs = [FULL, FULL | {"history": FULL["history"] | {"mode": "external"}}, BASE, {}, *[scrambled(r, FULL) for _ in range(100)], *map(profiled, PARAMETERS), *[scrambled(r, profiled(k)) for k in PARAMETERS for _ in range(12)]]
    texts = TEXTS + [json.dumps(d) for d in docs]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)] + [("none", None)], "record_key string, raw string")
    told = rec.column_facts(rows, WORDS)
    left = {x.record_key for x in told.where("kind = 'unread'").collect()}
    assert {str(k) for k in range(len(TEXTS))} - {"0", "1", "17", "18"} <= left | {"16"} and not left & {str(k) for k in range(len(TEXTS), len(texts))}
    full = lambda d: sorted(map(str, d.collect()))
    want = full(rec.parsed_facts(rows, WORDS))
    assert full(rec.facts(rows, WORDS)) == want and len(want) > 5000
    some = ["entity", "graph", "times"]
    assert full(rec.facts(rows, WORDS, some).drop("place")) == full(rec.parsed_facts(rows, WORDS).where("kind IN ('entity', 'graph', 'times')").drop("place"))


def depth_first(edges):
    """The paths that close a cycle, by plain recursion from the sorted origins."""
    after, state, found = {}, {}, []
    for a, b, p in edges:
        after.setdefault(a, []).append((b, p))

    def visit(node):
        state[node] = 1
        for b, p in after.get(node, []):
            if state.get(b) == 1:
                found.append(p)
            elif b not in state:
                visit(b)
        state[node] = 2

    for a in sorted(after):
        if a not in state:
            visit(a)
    return sorted(found)


def test_back_edges_of_random_multigraphs(spark):
    """Multi-edges, self-edges and relations stored backwards, against recursion; taking the found edges out leaves no cycle."""
    r = random.Random(2)
    rows, want = [], set()
    for n in range(60):
        relations = [{"predicate": r.choice(["ns:derived-from", "ns:has-part", "ns:other"]), "subject": f"n{r.randrange(6)}", "object": f"n{r.randrange(6)}"} for _ in range(r.randrange(1, 14))]
        edges = [(x["object"], x["subject"], f"/relations/{k}") if x["predicate"] == "ns:has-part" else (x["subject"], x["object"], f"/relations/{k}") for k, x in enumerate(relations) if x["predicate"] != "ns:other"]
        found = depth_first(edges)
        assert depth_first([e for e in edges if e[2] not in found]) == []
        want |= {(str(n), p) for p in found}
        rows.append((str(n), json.dumps({"relations": relations})))
    got = rec.semantics(spark.createDataFrame(rows, "record_key string, raw string"), WORDS, ["DERIVATION_CYCLE"])
    assert {(x.record_key, x.instance_path) for x in got.collect()} == want and len(want) > 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan
    other = rec.semantics(spark.createDataFrame(rows, "record_key string, raw string"), WORDS, ["UNRESOLVED_REF"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in other and "InArrow" not in other and "Pandas" not in other


def test_counts_of_facts_make_only_the_kinds_they_count(spark, monkeypatch):
    from tracewell.plans import corpus

    asked, facts = [], rec.facts
    monkeypatch.setattr(corpus.rec, "facts", lambda r, words, kinds=("all",): asked.append(set(kinds)) or facts(r, words, {"record"}))
    assert [tuple(r) for r in corpus.rec_facts(spark, "/root/testdata/sf0.001").collect()] == [("record", corpus.records(spark, "/root/testdata/sf0.001").count())]
    assert asked == [{"entity", "event", "outputs", "inputs", "window", "times", "relation", "record"}]


def test_texts_of_records_are_not_shuffled(spark):
    """The lines are dealt to all tasks by the session's partitions, before the long texts are made."""
    from tracewell.plans import corpus

    plan = corpus.records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert any("l_orderkey" in line and "REPARTITION_BY_NUM" in line for line in dealt) and not any("record_key" in line for line in dealt)


def test_records_are_read_without_taking_their_variant_apart_where_that_is_sure(spark):
    """Plain records fit the lean reader; strings that may have been other values, and all that only the whole text tells, do not."""
    from pyspark.sql import functions as F

    from tracewell.operators import fact_columns

    plain = {"id": "urn:r", "formatVersion": "1", "actors": [{"id": "urn:a"}, {"id": "urn:a"}], "x": [1.5, {"id": 7}]}
    odd = [plain | {"id": 5}, plain | {"actors": [{"id": 5}]}, plain | {"actors": [{"id": True}]}, plain | {"actors": {"id": "a"}}, plain | {"revision": "NaN"}, plain | {"formatVersion": 1}]
    texts = [json.dumps(d) for d in [plain, *odd]] + ['{"id":"x"}', '{"id":"x"} 1', '{"id":"x"},"k":{}', '{"a":{"b":1,"b":2}}', '[{"id":"x"}]', '{"a":[1e999]}', '{"a":' + "9" * 290 + "e20}", '{"a":' * 513 + "1" + "}" * 513, '{"__proto__":1}', '{"\\u0061":1}', "{"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "record_key string, raw string")
    kinds = frozenset(["record", "entity", "twin"])
    taken, fit, _ = fact_columns.lean(F.col("raw"), WORDS, rec.TABLES, kinds)
    rows = df.select("record_key", "raw", *[c.alias(n) for n, c in taken.items()])
    assert {r.record_key for r in rows.where(fit).collect()} == {"0", "7"}
    full = lambda d: sorted(map(str, d.drop("place").collect()))
    got = rec.facts(df, WORDS, kinds)
    assert full(got) == full(rec.parsed_facts(df, WORDS).where(F.col("kind").isin(*kinds)))
    assert ("0", "/actors/1") in {(r.record_key, r.path) for r in got.where("kind = 'twin'").collect()}


def test_each_kind_of_fact_by_itself_equals_the_parsers(spark):
    from tracewell.operators import fact_columns

    r = random.Random(4)
    texts = TEXTS + [json.dumps(d) for d in [FULL, BASE, *[scrambled(r, FULL) for _ in range(40)]]]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "record_key string, raw string")
    want = rec.parsed_facts(rows, WORDS).cache()
    for kinds in (["event", "times"], ["window", "twin"], ["record", "size", "ref"], ["diagnostic", "inputs", "outputs", "external"], ["relation"]):
        got = rec.facts(rows, WORDS, kinds)
        full = lambda d: sorted(map(str, d.drop("place").collect()))
        assert set(kinds) <= fact_columns.KINDS and full(got) == full(want.where(want["kind"].isin(*kinds))), kinds


def test_repeated_ids_are_found_without_a_window(spark):
    df = spark.createDataFrame([("a", json.dumps(BASE | {"claims": [{"id": "urn:a"}, {"id": "urn:c"}, {"id": "urn:a"}]}))], "record_key string, raw string")
    got = rec.semantics(df, WORDS, ["DUPLICATE_ID"])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.instance_path for r in got.collect()} == {"/claims/0", "/claims/2"}


def test_sound_texts_are_not_scanned_and_odd_ones_give_the_same(monkeypatch):
    """Python's decoder and encoder take what they are sure of; audits judge equal keys and strings once."""
    from tracewell.functions import names
    from tracewell.sources import strict_json as sj

    def result(fn, *given):
        try:
            return repr(fn(*given))
        except sj.JsonError as e:
            return e.code, e.pointer

    deep = ["[" * n + "]" * n for n in (512, 513, 100_000)]
    for text in [*deep, '{"a":1,"a":2}', '{"b":{"__proto__":1}}', "1e400", "-0", "-0.0", "9007199254740993", "1.5e300", "NaN", "1 2", "", "01", '["\x01"]', "\ufeff1", '"\\ud83d"']:
        assert result(sj.parse, text) == result(sj.scan, text), text[:40]
    for value in [5.0, -0.0, [1e20, 1e22, 1.5], {"a": float("nan")}, {"\ue000": 1, "\U0001f600": 2}, ["a:5.0", "e+"], {1}, 10**30, (True, None)]:
        assert result(sj.stable, value) == result(sj.written, value)
    monkeypatch.setattr(sj, "scan", lambda text: pytest.fail("scanned"))
    monkeypatch.setattr(sj, "written", lambda value: pytest.fail("written a value at a time"))
    hidden = [{"id": f"urn:h{k}", "/": "/home/x"} for k in range(300)]
    doc = sj.parse(json.dumps(PUBLIC | {"claims": hidden}))
    seen = []
    monkeypatch.setattr(names, "is_local_locator", lambda text: seen.append(text) or text.startswith("/"))
    public._short_problems.cache_clear()
    out = public.project(doc, WORDS)
    assert [x["pointer"] for x in out["publication"]["omissions"]][-300:] != [] and sj.stable(out)
    assert public.audit(out, WORDS) == [] and len(seen) == len(set(seen)) >= 300
    out["publication"]["omissions"].append({"pointer": "/etc/passwd", "category": "c", "reason": "r"})
    assert [c for c, _ in public.audit(out, WORDS)] == ["PUBLIC_PATH"]


def test_lines_of_records_are_made_before_they_are_gathered(spark):
    """A record's lines are neither grouped by hash nor taken apart by functions of lists; orders without lines make no record."""
    from tracewell.plans import corpus

    made = corpus.records(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "sort_array" not in plan and "HashAggregate" not in plan
    for r in made.limit(50).collect():
        doc = json.loads(r.raw)
        parts, events = [x["id"] for x in doc["representations"]], doc["history"]["events"]
        assert [(x["object"], x["subject"]) for x in doc["relations"]] == list(zip(parts, parts[1:]))
        assert [x["outputs"] for x in events] == [[p] for p in parts] and [x["inputs"] for x in events] == [[], *[[p] for p in parts[:-1]]]
        assert [x["id"] for x in events] == [f"urn:event:{r.record_key}:{k}" for k in range(len(parts))]


def test_a_summary_needs_one_fact_of_a_record(spark):
    """Counts stand in the record's own fact, whichever reader made it; of facts of a kind for each collection none is read."""
    docs = [FULL, FULL | {"history": {"mode": "external", "eventIds": ["x"]}}, {"actors": [1, None, {}], "relations": {}, "id": 3}, FULL | {"id": "\u0007"}]
    df = spark.createDataFrame([(str(k), json.dumps(d)) for k, d in enumerate(docs)], "record_key string, raw string")
    f = rec.facts(df, WORDS, ["record"])
    assert f.count() == len(docs) and {x.kind for x in f.collect()} == {"record"}
    got = {r.record_key: r for r in rec.summary(f).collect()}
    for k, d in enumerate(docs):
        for name in rec.COLLECTIONS:
            v = d.get(name)
            assert got[str(k)][name] == (len(v) if isinstance(v, list) else 0), (k, name)
        assert got[str(k)].events == (len(d["history"]["events"]) if d.get("history", {}).get("mode") == "embedded" else 0)
