import hashlib
import json
import os
import zipfile

from tracewell import cli
from tracewell.operators import records as rec
from tracewell.plans import validation, verification
from tracewell.sources import bundles

from .test_bundles import entry, folder, manifest
from .test_records import BASE, WORDS

SOUND = BASE | {"history": {"mode": "external", "href": "events.ndjson", "eventIds": ["urn:e"]}}
RECEIPT = {"id": "urn:e", "recordId": "urn:r", "sequence": 0}


def bundle(records, receipts, **more):
    """The files of a bundle with a true manifest: records by path, and the lines of its log (None: no log)."""
    files = {p: (r if isinstance(r, str) else json.dumps(r), "record") for p, r in records.items()}
    if receipts is not None:
        files["events.ndjson"] = ("".join(json.dumps(r) + "\n" for r in receipts), "event-log")
    ids = {p: r["id"] if isinstance(r, dict) else f"urn:{p}" for p, r in records.items()}
    listed = [entry(p, role, byteLength=len(t), sha256=hashlib.sha256(t.encode()).hexdigest(), **({"recordRef": ids[p]} if role == "record" else {})) for p, (t, role) in files.items()]
    return {p: t for p, (t, _) in files.items()} | {"manifest.json": json.dumps(manifest([(i, p) for p, i in ids.items()], listed) | more)}


CASES = {
    "sound": (bundle({"r/1.json": SOUND}, [RECEIPT]), set()),
    "no log": (bundle({"r/1.json": SOUND}, None), {("BUNDLE_EVENT_LOG_MISSING", "r/1.json", "/files/0/history"), ("BUNDLE_EVENT_CLOSURE", "events.ndjson", "")}),
    "elsewhere": (bundle({"r/1.json": SOUND | {"history": SOUND["history"] | {"href": "other"}}}, [RECEIPT]), {("BUNDLE_EVENT_PATH_INVALID", "r/1.json", "/files/0/history/href")}),
    "bad records": (
        bundle({"r/1.json": SOUND, "r/2.json": '{"id": 1, "id": 2}', "r/3.json": BASE | {"id": "urn:t", "createdBy": "urn:z", "history": BASE["history"] | {"events": [BASE["history"]["events"][0] | {"recordId": "urn:t"}]}}}, [RECEIPT]),
        {("BUNDLE_RECORD_INVALID_JSON", "r/2.json", "/files/1"), ("UNRESOLVED_REF", "r/3.json", "/files/2/createdBy")},
    ),
    "receipts": (
        bundle({"r/1.json": SOUND}, [RECEIPT | {"sequence": 5}, RECEIPT, {"id": "urn:f", "recordId": "urn:none", "sequence": 9}]),
        {("BUNDLE_EVENT_DUPLICATE_ID", "events.ndjson", "/files/1/1"), ("BUNDLE_EVENT_SEQUENCE", "events.ndjson", "/files/1/1"), ("BUNDLE_EVENT_CLOSURE", "events.ndjson", "/files/1"), ("BUNDLE_EVENT_UNDECLARED", "events.ndjson", "/files/1"), ("BUNDLE_EVENT_RECORD_UNRESOLVED", "events.ndjson", "/files/1/2/recordId")},
    ),
}


def found(rows):
    return {(r.code, r.path, r.instance_path) for r in rows}


def test_zip_bundles_are_verified_as_a_whole(spark, tmp_path):
    for name, (files, _) in CASES.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for p, t in files.items():
                z.writestr(p, t)
    (tmp_path / "none.zip").write_bytes(b"no zip")
    rows = verification.verify(bundles.zip_bundles(spark, str(tmp_path)), WORDS).collect()
    by = lambda n: [r for r in rows if os.path.basename(r.bundle).replace("%20", " ") == f"{n}.zip"]
    assert {n: found(by(n)) for n in CASES} == {n: x for n, (_, x) in CASES.items()}
    assert found(by("none")) >= {("BUNDLE_ZIP_INVALID", "", "")}
    assert [r.bundle for r in rows] == sorted(r.bundle for r in rows)


def test_folders_are_verified_with_receipt_schemas_and_written_once(spark, tmp_path, capsys):
    words = ["--relations", "ns", "--operations", "op"]
    folder(tmp_path / "b", CASES["sound"][0])
    assert cli.main(["verify", str(tmp_path / "b"), *words]) == 0 and cli.main(["inspect", str(tmp_path / "b")]) == 0
    folder(tmp_path / "s", {"r.json": json.dumps({"$id": "urn:s", "type": "object"}), "e.json": json.dumps({"$id": "urn:receipt", "type": "object", "required": ["effectClass"]})})
    b = bundles.folder_bundle(spark, str(tmp_path / "b"), "b")
    got = verification.verify(b, WORDS, cli.schemas_of(str(tmp_path / "s")), "urn:s", "urn:receipt")
    assert found(got.collect()) == {("SCHEMA_INVALID", "events.ndjson", "/files/1/0/effectClass"), ("BUNDLE_EVENT_CLOSURE", "events.ndjson", "/files/1")}
    folder(tmp_path / "c", CASES["no log"][0])
    out = ["--out", str(tmp_path / "out")]
    capsys.readouterr()
    assert cli.main(["verify", str(tmp_path / "c"), *words, *out]) == 1 and capsys.readouterr().out == ""
    assert found(spark.read.json(out[1]).collect()) == CASES["no log"][1]
    assert cli.main(["verify", str(tmp_path / "b"), *words, *out]) == 3
    assert json.loads(capsys.readouterr().err.splitlines()[-1]) == {"code": "OUTPUT_EXISTS"}
    assert cli.main(["capabilities"]) == 0 and json.loads(capsys.readouterr().out)["limits"]["entries"] == 10_000


def test_other_versions_are_named_only_where_structure_fails(spark):
    schemas = {"urn:s": {"$id": "urn:s", "type": "object", "required": ["id"]}}
    docs = {"old": {"formatVersion": "0.1.0"}, "null": {"formatVersion": None}, "same": {"formatVersion": WORDS.version}, "none": {}, "list": [], "sound": BASE | {"formatVersion": "0.1.0"}}
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "record_key string, raw string")
    got = validation.diagnose(rows, WORDS, schemas, "urn:s").where("code = 'UNSUPPORTED_VERSION'").collect()
    assert {(r.record_key, r.instance_path) for r in got} == {("old", "/formatVersion"), ("null", "/formatVersion")}


def test_every_declaration_is_held_against_the_log(spark):
    receipts = spark.createDataFrame([("l", 1, "a", "x", 0, None)], "log string, line long, id string, record_id string, sequence long, code string")
    declared = spark.createDataFrame([("l", "x", "a"), ("l", "y", "a")], "log string, record_id string, id string")
    got = {(r.code, r.id) for r in bundles.event_closure(declared, receipts).collect()}
    assert got == {("BUNDLE_EVENT_DECLARATION_DUPLICATE", "a"), ("BUNDLE_EVENT_RECORD_MISMATCH", "a")}
