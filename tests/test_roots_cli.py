import json
import os
import zipfile

import pytest

from tracewell import cli
from tracewell.sources.roots import PathEscape, confined

from .test_bundles import FAULTY
from .test_records import BASE


def test_confinement(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "ab").mkdir()
    os.symlink("/etc", tmp_path / "a/link")
    root = [str(tmp_path / "a")]
    assert confined(f"{root[0]}/x.json", root) == os.path.realpath(f"{root[0]}/x.json")
    for bad in ("../ab", "link/passwd", "../../etc"):
        with pytest.raises(PathEscape) as e:
            confined(f"{root[0]}/{bad}", root)
        assert bad not in str(e.value)


def test_commands(spark, tmp_path, capsys):
    words = ["--relations", "ns", "--operations", "op"]
    (tmp_path / "r.json").write_text(json.dumps(BASE))
    assert cli.main(["validate", str(tmp_path), *words]) == 0
    (tmp_path / "bad.json").write_text("{")
    assert cli.main(["validate", str(tmp_path), *words]) == 1
    assert '"code":"JSON_SYNTAX"' in capsys.readouterr().out
    assert cli.main(["lineage", str(tmp_path), "urn:p", *words]) == 0
    assert '"id":"urn:q","depth":1' in capsys.readouterr().out
    assert cli.main(["nothing"]) == 2
    assert cli.main(["lineage", str(tmp_path), "urn:p", *words, "--depth", "65"]) == 3
    assert json.loads(capsys.readouterr().err.splitlines()[-1]) == {"code": "LINEAGE_LIMIT_INVALID"}


def test_lineage_goes_both_ways_by_default(spark, tmp_path, capsys):
    words = ["--relations", "ns", "--operations", "op"]
    (tmp_path / "r.json").write_text(json.dumps(BASE))
    assert cli.main(["lineage", str(tmp_path), "urn:q", *words]) == 0
    assert '"id":"urn:p","depth":1,"direction":"ancestors"' in capsys.readouterr().out


def test_inspect_checks_manifests(spark, tmp_path, capsys):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("manifest.json", json.dumps(FAULTY))
    assert cli.main(["inspect", str(tmp_path)]) == 1
    out = capsys.readouterr().out
    assert '"code":"BUNDLE_EVENT_LOG_DUPLICATE"' in out and '"code":"BUNDLE_COVERAGE_MISMATCH"' in out


def test_schemas_audits_and_requests(spark, tmp_path, capsys):
    words = ["--relations", "ns", "--operations", "op"]
    for name, text in (("r/r.json", BASE), ("s/s.json", {"$id": "urn:s", "type": "object", "required": ["operationType"]})):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(json.dumps(text))
    records, schemas = str(tmp_path / "r"), ["--schemas", str(tmp_path / "s"), "--schema-id", "urn:s"]
    assert cli.main(["validate", records, *words, *schemas]) == 1 and '"code":"SCHEMA_INVALID"' in capsys.readouterr().out
    assert cli.main(["validate", records, *words, *schemas[:2]]) == 2
    assert cli.main(["audit-public", records, *words]) == 1 and '"code":"PUBLIC_DISCLOSURE"' in capsys.readouterr().out
    assert cli.main(["conformance", "reader", records, *words]) == 0 and '"status":"partial"' in capsys.readouterr().out
    assert cli.main(["conformance", "publisher", records, *words]) == 1
    assert cli.main(["schema-list", schemas[1]]) == 0 and cli.main(["schema-show", schemas[1], "urn:none"]) == 2
    capsys.readouterr()
    assert cli.main(["process-template", "granulate", "--operations", "op", "--inputs", "urn:p"]) == 0
    (tmp_path / "q").mkdir()
    (tmp_path / "q/q.json").write_text(capsys.readouterr().out)
    assert cli.main(["process-check", str(tmp_path / "q"), *schemas]) == 0


def test_commands_keep_to_their_roots(spark, tmp_path, capsys):
    words = ["--relations", "ns", "--operations", "op"]
    for name in ("in", "out"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.json").write_text(json.dumps(BASE))
    os.symlink(tmp_path / "out", tmp_path / "in/link")
    root = ["--root", str(tmp_path / "in")]
    assert cli.main(["validate", str(tmp_path / "in"), *words, *root]) == 0
    for bad in (["validate", str(tmp_path / "out"), *words], ["summary", str(tmp_path / "in/link"), *words], ["summary", str(tmp_path / "in"), *words, "--out", str(tmp_path / "out/new")], ["schema-list", str(tmp_path / "in/../out")]):
        assert cli.main([*bad, *root]) == 3
        assert json.loads(capsys.readouterr().err.splitlines()[-1]) == {"code": "PATH_ESCAPE"}
    assert cli.main(["schema-list", str(tmp_path / "out"), *root, "--root", str(tmp_path / "out")]) == 0


def test_audits_check_structure_first(spark, tmp_path, capsys):
    words = ["--relations", "ns", "--operations", "op"]
    for name, text in (("r/a.json", BASE), ("r/b.json", BASE | {"extra": 1}), ("s/s.json", {"$id": "urn:s", "properties": {"extra": False}})):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(text))
    assert cli.main(["audit-public", str(tmp_path / "r"), *words, "--schemas", str(tmp_path / "s"), "--schema-id", "urn:s"]) == 1
    found = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert {(x["record_key"][-6:], x["code"]) for x in found if x["record_key"].endswith("b.json")} == {("b.json", "SCHEMA_INVALID")}
    assert {x["code"] for x in found if x["record_key"].endswith("a.json")} >= {"PUBLIC_DISCLOSURE"}
