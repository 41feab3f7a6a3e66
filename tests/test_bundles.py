import hashlib
import json
import os
import zipfile

import pytest

from tracewell.sources import bundles


def folder(path, files):
    for name, text in files.items():
        full = os.path.join(path, name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def test_pack_is_deterministic_and_unpacks(tmp_path):
    folder(tmp_path / "b", {"manifest.json": "{}", "r/x.json": "1"})
    bundles.pack(str(tmp_path / "b"), str(tmp_path / "1.zip"))
    os.utime(tmp_path / "b/manifest.json", (0, 0))
    bundles.pack(str(tmp_path / "b"), str(tmp_path / "2.zip"))
    assert (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes()
    bundles.unpack(str(tmp_path / "1.zip"), str(tmp_path / "out"))
    assert (tmp_path / "out/r/x.json").read_text() == "1"
    for call in (lambda: bundles.pack(str(tmp_path / "b"), str(tmp_path / "1.zip")), lambda: bundles.unpack(str(tmp_path / "1.zip"), str(tmp_path / "out"))):
        with pytest.raises(bundles.BundleError) as e:
            call()
        assert e.value.code == "BUNDLE_DESTINATION_EXISTS"
    os.symlink("/etc/passwd", tmp_path / "b/link")
    with pytest.raises(bundles.BundleError) as e:
        bundles.pack(str(tmp_path / "b"), str(tmp_path / "3.zip"))
    assert e.value.code == "BUNDLE_SYMLINK"


def test_entries_and_manifest(spark, tmp_path):
    z = tmp_path / "z"
    z.mkdir()
    with zipfile.ZipFile(z / "a.zip", "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("manifest.json", "{}")
        f.writestr("r/x.json", "one")
        f.writestr("R/X.json", "two")
        f.writestr("../evil", "x")
        f.writestr("bomb", "0" * 1_000_000)
        f.writestr("extra", "x")
    (z / "b.zip").write_bytes(b"no zip")
    entries = bundles.zip_entries(spark, str(z)).cache()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    a = next(r.bundle for r in entries.collect() if r.path == "extra")
    declared = spark.createDataFrame([(a, "r/x.json", 4, sha("one").upper()), (a, "R/X.json", 3, sha("no")), (a, "gone", 1, sha(""))], "bundle string, path string, byte_length long, sha256 string")
    got = {(r.code, r.path) for r in bundles.manifest_findings(declared, entries).collect() if r.bundle == a}
    assert got == {("BUNDLE_SIZE_MISMATCH", "r/x.json"), ("BUNDLE_DIGEST_MISMATCH", "R/X.json"), ("BUNDLE_COVERAGE_MISMATCH", "gone"), ("BUNDLE_COVERAGE_MISMATCH", "extra"), ("BUNDLE_PATH_TRAVERSAL", "../evil"), ("BUNDLE_COMPRESSION_RATIO", "bomb"), ("BUNDLE_PATH_COLLISION", "r/x.json")}
    assert [r.code for r in entries.collect() if r.bundle != a] == ["BUNDLE_ZIP_INVALID"]


def test_folder_entries(spark, tmp_path):
    folder(tmp_path / "b", {"manifest.json": "{}", "r/x y.json": "1"})
    got = {r.path.replace("%20", " "): (r.length, r.sha256) for r in bundles.folder_entries(spark, str(tmp_path / "b"), "b").collect()}
    assert got["r/x y.json"] == (1, hashlib.sha256(b"1").hexdigest()) and set(got) == {"manifest.json", "r/x y.json"}


LOG = [{"id": "a", "sequence": 5, "recordId": "r"}, {"id": "b", "sequence": 3, "recordId": "r"}, {"id": "a", "sequence": 4, "recordId": "q"}]


def test_receipts(spark, tmp_path):
    (tmp_path / "l.ndjson").write_bytes(b"\r\n".join(json.dumps(x).encode() for x in LOG) + b"\n\n{\n{}")
    got = bundles.read_receipts(spark, str(tmp_path)).cache()
    found = sorted((r.line, r.code) for r in bundles.receipt_findings(got).collect())
    assert found == [(2, "BUNDLE_EVENT_SEQUENCE"), (3, "BUNDLE_EVENT_DUPLICATE_ID"), (4, "BUNDLE_EVENT_BLANK_LINE"), (5, "BUNDLE_EVENT_INVALID_JSON"), (6, "BUNDLE_EVENT_PARTIAL_FINAL_LINE")]
    log = got.first().log
    declared = spark.createDataFrame([(log, "r", "a"), (log, "r", "z"), (log, "x", "z")], "log string, record_id string, id string")
    closure = sorted((r.code, r.id) for r in bundles.event_closure(declared, got).collect())
    assert closure == [("BUNDLE_EVENT_CLOSURE", "a"), ("BUNDLE_EVENT_CLOSURE", "z"), ("BUNDLE_EVENT_DECLARATION_DUPLICATE", "z"), ("BUNDLE_EVENT_RECORD_MISMATCH", "a"), ("BUNDLE_EVENT_UNDECLARED", "b")]


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    from tracewell.streaming import receipts

    schema = "log string, line long, id string, sequence long"
    rows = [("l", n, x["id"], x["sequence"]) for n, x in enumerate(LOG, 1)]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    q = receipts.findings(stream).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.line, r.code) for r in spark.table("found").collect()) == [(2, "BUNDLE_EVENT_SEQUENCE"), (3, "BUNDLE_EVENT_DUPLICATE_ID")]


def test_stream_with_nulls_and_a_restart_equals_the_batch(spark, tmp_path):
    """Random logs in three runs over one checkpoint, with null ids and sequences, against the batch form over all."""
    import random

    from tracewell.streaming import receipts

    r = random.Random(6)
    schema = "log string, line long, id string, sequence long"
    rows = [(f"l{k % 3}", k, r.choice([None, f"e{r.randrange(25)}"]), r.choice([None, k, r.randrange(60)])) for k in range(60)]
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    for k, part in enumerate((rows[:25], rows[25:30], rows[30:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
        q = receipts.findings(stream()).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(x.log, x.code, x.line) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.createDataFrame([(*x, None) for x in rows], schema + ", code string")
    want = {(x.log, x.code, x.line) for x in bundles.receipt_findings(batch).collect()}
    assert got == want and {c for _, c, _ in got} == {"BUNDLE_EVENT_SEQUENCE", "BUNDLE_EVENT_DUPLICATE_ID"}


def entry(path, role, **more):
    return {"path": path, "role": role, "mediaType": "a/b", "byteLength": 1, "sha256": "0" * 64, "disclosure": "private"} | more


def manifest(records, files):
    head = {"manifestType": "some-bundle", "manifestVersion": "0.2.0", "formatVersion": "0.2.0", "id": "urn:m", "createdAt": "2026-01-01T00:00:00Z", "createdBy": "urn:a", "disclosure": "private", "profiles": ["core"]}
    return head | {"records": [{"id": i, "path": p} for i, p in records], "files": files, "externalReferences": [], "omissions": [], "extensions": {}}


SOUND = manifest([("urn:1", "r/1.json")], [entry("events.ndjson", "event-log"), entry("r/1.json", "record", recordRef="urn:1")])
FAULTY = manifest(
    [("urn:1", "r/1.json"), ("urn:1", "r/2.json"), ("urn:3", "r/3.json"), ("urn:4", "gone.json")],
    [entry("r/1.json", "record"), entry("r/2.json", "other"), entry("r/3.json", "record", recordRef="urn:9"), entry("r/5.json", "record"), entry("events.ndjson", "event-log"), entry("more.ndjson", "event-log")],
)
FAULTS = {
    ("DUPLICATE_ID", "r/2.json"), ("BUNDLE_RECORD_REFERENCE_DUPLICATE", "r/2.json"), ("BUNDLE_RECORD_REFERENCE_INVALID", "r/2.json"), ("BUNDLE_RECORD_REFERENCE_INVALID", "gone.json"),
    ("BUNDLE_RECORD_REFERENCE_MISMATCH", "r/3.json"), ("UNRESOLVED_REF", "r/3.json"), ("BUNDLE_RECORD_UNREFERENCED", "r/5.json"), ("BUNDLE_EVENT_PATH_INVALID", "more.ndjson"), ("BUNDLE_EVENT_LOG_DUPLICATE", "more.ndjson"),
    ("BUNDLE_RECORD_ID_MISMATCH", "r/1.json"), ("BUNDLE_UNMANIFESTED_ENTRY", "empty"),
}


def test_manifests_are_read_and_their_references_checked(spark, tmp_path):
    for name, m in (("sound", SOUND), ("faulty", FAULTY)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("manifest.json", json.dumps(m))
            z.mkdir("r")
            if name == "faulty":
                z.mkdir("empty")
    with zipfile.ZipFile(tmp_path / "broken.zip", "w") as z:
        z.writestr("manifest.json", '{"id": 1, "id": 2}')
    (tmp_path / "none.zip").write_bytes(b"no zip")
    m = bundles.zip_manifests(spark, str(tmp_path)).cache()
    by = {os.path.basename(r.bundle): r.bundle for r in m.collect()}
    documents = spark.createDataFrame([(by["faulty.zip"], "r/1.json", "urn:8"), (by["sound.zip"], "r/1.json", "urn:1")], "bundle string, path string, id string")
    got = {(os.path.basename(r.bundle), r.code, r.path) for r in bundles.reference_findings(m, documents).collect()}
    assert got == {("faulty.zip", *x) for x in FAULTS} | {("broken.zip", "BUNDLE_MANIFEST_INVALID_JSON", "manifest.json")}
    assert {(r.path, r.byte_length) for r in bundles.declared_files(m).where(f"bundle = '{by['sound.zip']}'").collect()} == {("events.ndjson", 1), ("r/1.json", 1)}


def test_manifest_forms():
    code = lambda m, **k: bundles.read_manifest("b", m if isinstance(m, bytes) else json.dumps(m).encode(), **k)[0][-1]
    assert code(SOUND) is None and code(b"\xff") == "BUNDLE_MANIFEST_INVALID_JSON" and code(SOUND, limits=bundles.Limits(manifest=10)) == "BUNDLE_MANIFEST_LIMIT"
    for bad in ([], {}, SOUND | {"records": []}, SOUND | {"extra": 1}, SOUND | {"files": [entry("a", "none")]}, SOUND | {"files": [entry("a", "other", sha256="0")]}, SOUND | {"files": [entry("a", "other", byteLength=-1)]}):
        assert code(bad) == "SCHEMA_INVALID"


def test_folder_limits_and_manifest(spark, tmp_path):
    folder(tmp_path / "b", {"manifest.json": json.dumps(SOUND), "r/1.json": "12345", "s/manifest.json": "{"})
    at = str(tmp_path / "b")
    codes = lambda **k: {(r.path, r.code) for r in bundles.folder_entries(spark, at, "b", bundles.Limits(**k)).collect() if r.code}
    assert codes() == set() and codes(entries=4) == {("", "BUNDLE_ENTRY_COUNT_LIMIT")} and codes(entries=5) == set() and codes(total=9) == {("", "BUNDLE_TOTAL_LIMIT")}
    assert codes(entry=4) == {("r/1.json", "BUNDLE_ENTRY_LIMIT"), ("manifest.json", "BUNDLE_ENTRY_LIMIT")}
    assert {r.path for r in bundles.folder_manifest(spark, at, "b").where("kind = 'file'").collect()} == {"events.ndjson", "r/1.json"}
    assert bundles.folder_manifest(spark, at, "b", bundles.Limits(manifest=9)).first().code == "BUNDLE_MANIFEST_LIMIT"
