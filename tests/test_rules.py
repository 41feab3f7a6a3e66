"""Rules judged where a record stands, against the joins over facts and against the parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_records import BASE, FULL, TEXTS, WORDS, scrambled
from tracewell.operators import lineage, public, records as rec

IDS = ["urn:p", "urn:q", "urn:r", "urn:x", None, 3]


def receipt(r):
    return {"id": r.choice(["e1", "e2", None]), "recordId": r.choice(["urn:d", "urn:e", None]), "effectClass": r.choice(["transform", "observe", "render"]), "inputs": [r.choice(IDS) for _ in range(r.randrange(3))], "outputs": [r.choice(IDS) for _ in range(r.randrange(3))]}


def relation(r):
    return {"predicate": r.choice(["ns:derived-from", "ns:derivation-of", "ns:part-of", "ns:rendered-as", "o:x", ""]), "subject": r.choice(IDS), "object": r.choice(IDS), "operationRef": r.choice(["e1", "e2", "e3", None])}


def documents():
    """Random records, most of them plain; and two with more failing ids than columns look up."""
    r, out = random.Random(21), [FULL, BASE]
    out += [scrambled(r, FULL) for _ in range(15)]
    for _ in range(120):
        d = {"id": "urn:d", "actors": [{"id": r.choice(IDS)}], "representations": [{"id": r.choice(IDS)} for _ in range(r.randrange(4))], "relations": [relation(r) for _ in range(r.randrange(6))]}
        d["history"] = {"mode": r.choice(["embedded", "embedded", "external"]), "eventIds": ["e1", 3], "events": [r.choice([receipt(r)] * 9 + [None, "x"]) for _ in range(r.randrange(5))]}
        out.append(json.loads(json.dumps(d).replace("null", '"n"').replace(" 3", ' "z"')) if r.random() < 0.7 else d)
    ids = [f"u{k}" for k in range(150)]
    events = [{"id": f"e{k}", "effectClass": "render", "inputs": ids, "outputs": ids} for k in range(4)]
    many = {"id": "m", "actors": [{"authorityRefs": [f"x{k}" for k in range(150)]}], "representations": [{"id": x} for x in ids], "relations": [{"predicate": "ns:derived-from", "subject": x, "object": x} for x in ids], "history": {"mode": "embedded", "events": events}}
    return TEXTS + [json.dumps(d) for d in [*out, many, many | {"representations": []}]]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(documents())] + [("none", None)], "record_key string, raw string")


@pytest.fixture(scope="module")
def joined(rows):
    return rec.facts(rows, WORDS)


def judged(rows, joined, code, kinds):
    """The findings of a rule, which are those of the joins and of the parser, and need no join."""
    got = rec.semantics(rows, WORDS, [code])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    told = sorted(map(tuple, got.collect()))
    assert told == sorted(map(tuple, rec.findings(joined, WORDS, [code]).collect())) and len(told) > 50
    parsed = rec.parsed_facts(rows, WORDS, kinds).where(F.col("kind").isin(kinds)).select("record_key", "path").distinct()
    assert [(x[0], x[3]) for x in told] == sorted(map(tuple, parsed.collect()))
    return told


def test_f8_references_are_resolved_without_joins(rows, joined):
    assert {p for *_, p in judged(rows, joined, "UNRESOLVED_REF", ["dangling", "foreign"])} >= {"/history/events/0/recordId", "/history/events/0/inputs/0", "/relations/0/operationRef", "/actors/0/authorityRefs/149"}


def test_f6_receipts_are_tied_without_joins(rows, joined):
    assert {p.rpartition("/")[2] for *_, p in judged(rows, joined, "DESCENDANT_RECEIPT", ["unreceipted"])} == {"operationRef", "outputs"}


def test_f3_reuse_is_found_without_joins(rows, joined):
    assert {p.rpartition("/")[2] for *_, p in judged(rows, joined, "DESCENDANT_REUSES_INPUT", ["reused"])} >= {"subject", "0"}


def test_f5_lineage_of_a_place_is_searched_in_its_record(spark, rows, joined):
    """Both ways and at several depths, the nodes and places of the report that joins entities and edges; nothing is shuffled."""
    f = rec.facts(rows, WORDS, ["descent"])
    entities = joined.where("kind = 'entity'").select("record_key", "id", F.col("a").alias("collection"), F.col("b").alias("type"), "path", "place")
    roots = entities.where("path = '/representations/0'").select("record_key", "id")
    names = ["record_key", "root", "id", "depth", "path", "truncated"]
    for way, depth in (("descendants", 16), ("descendants", 1), ("ancestors", 2)):
        got = lineage.trace_descents(f, "/representations/0", way, depth)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = lineage.report(entities, rec.lineage_edges(joined, WORDS), roots, way, depth, sort=False)[0].select(*names)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 10
    parsed = rec.parsed_facts(rows, WORDS, ["descent"]).where("kind = 'descent'").select("record_key", "n", "expected")
    assert sorted(map(str, f.select(*parsed.columns).collect())) == sorted(map(str, parsed.collect()))
    with pytest.raises(lineage.LineageError):
        lineage.trace_descents(f, "/representations/0", "sideways")


def test_f1_projections_are_audited_where_that_is_asked(spark, monkeypatch):
    """Audits change no projection, and a query that reads none has none made."""
    from tests.test_records import PUBLIC
    from tracewell.plans import corpus

    named = PUBLIC | {"title": [PUBLIC["id"], {"a": PUBLIC["id"], "b": [[], {}, "x"]}], "publication": PUBLIC["publication"] | {"omissions": [{"pointer": PUBLIC["id"]}, 5]}}
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate([json.dumps(PUBLIC), json.dumps(named), json.dumps(FULL), "{", None])], "record_key string, raw string")
    bare, whole = public.projections(df, WORDS, audited=False), public.projections(df, WORDS)
    assert bare.columns == ["record_key", "projection", "code"]
    assert sorted(map(str, bare.collect())) == sorted(map(str, whole.drop("findings").collect()))
    out = json.loads(bare.where("record_key = '1'").first().projection)
    assert out["title"] == ["urn:pub", {"a": "urn:pub", "b": [[], {}, "x"]}] and out["publication"]["omissions"][0] == {"pointer": "urn:pub"}
    asked, made = [], public.projections
    monkeypatch.setattr(corpus.public, "projections", lambda *a, **k: asked.append(k) or made(*a, **k))
    corpus.rec_projection(spark, "/root/testdata/sf0.001")
    assert asked == [{"audited": False}]


def test_f2_profiles_are_judged_without_variant_where_that_is_sure(spark):
    """Declared profiles of all kinds, with parameters, outputs and members of other types: columns tell what the parser tells."""
    from tests.test_records import PARAMETERS, profiled
    from tracewell.operators import profile_columns, profiles

    r, docs = random.Random(12), [FULL, BASE]
    odd = ["", "x", '{"kind":"mixdown"}', "[1]", "5", 5, 0, 1.5, True, [], ["o"], [5], {}, {"kind": "mixdown"}, {"kind": "mixdown", "factor": 0}, {"preservationIntent": 1}, {"a": None}, None]
    for _ in range(200):
        d = json.loads(json.dumps(profiled(r.choice(list(PARAMETERS)))))
        d["profiles"] = r.sample([*profiles.PROFILES, "odd"], r.randrange(6)) + r.choice([[], [], [], [5], ["core", "core"]])
        e = d["history"]["events"][0]
        for _ in range(r.randrange(3)):
            e[r.choice(["parameters", "parameters", "outputs", "finalStatus", "effectClass", "policyEvaluation"])] = r.choice(odd)
        if r.random() < 0.2:
            d[r.choice(["measurements", "regions", "representations", "relations", "actors", "observations", "publication"])] = r.choice(odd * (r.random() < 0.5) + [[{"actorKind": "agent", "operationRef": "e"}]])
        if r.random() < 0.2:
            d["history"] |= {"mode": "external", "eventIds": r.choice([[], ["e"], [5], "e"])}
        docs.append(d)
    docs += [scrambled(r, profiled(k)) for k in PARAMETERS for _ in range(8)]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(TEXTS + [json.dumps(d) for d in docs])] + [("none", None)], "record_key string, raw string")
    taken, fit, _ = profile_columns.lean(F.col("raw"), WORDS)
    assert rows.select("record_key", "raw", *[c.alias(n) for n, c in taken.items()]).where(fit).count() > 60  # most of the others hold nulls, or another type where one is asked for
    key = lambda d: sorted(map(tuple, d.where("kind = 'profile'").select("record_key", "a", "n").collect()))
    want = key(rec.parsed_facts(rows, WORDS))
    assert key(rec.facts(rows, WORDS, ["profile"])) == want
    assert {a for _, a, _ in want} >= {*profiles.PROFILES, "odd"}
