"""Commands over folders of records and bundles. Exit codes: 0 sound, 1 findings, 2 usage, 3 failure."""

from __future__ import annotations

import argparse
import json
import os
import sys

PROCESSES = ("granulate", "extract", "reduce", "fragment", "timestretch", "pitchshift")
CLASSES = ("reader", "writer", "transformer", "agent-host", "publisher")
#: Commands whose findings make the exit code 1.
JUDGES = ("validate", "inspect", "verify", "audit-public", "process-check", "conformance")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracewell")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "verify", "summary", "project", "audit-public", "conformance"):
        s = sub.add_parser(name)
        if name == "conformance":
            s.add_argument("kind", choices=CLASSES)
        s.add_argument("path")
        s.add_argument("--relations", required=True, help="namespace of the registered relations")
        s.add_argument("--operations", required=True, help="namespace of the operation types")
        s.add_argument("--include", nargs="*", default=[], help="ids of entities that were reviewed for publication")
        s.add_argument("--schemas", help="folder of JSON Schema documents, for validate, verify and conformance")
        s.add_argument("--schema-id", help="$id of the schema of records")
        if name == "verify":
            s.add_argument("--receipt-schema-id", help="$id of the schema of the lines of event logs")
    s = sub.add_parser("lineage")
    s.add_argument("path")
    s.add_argument("root")
    s.add_argument("--relations", required=True)
    s.add_argument("--operations", required=True)
    s.add_argument("--direction", choices=["ancestors", "descendants", "both"], default="both")
    s.add_argument("--depth", type=int, default=16)
    sub.add_parser("inspect").add_argument("path")
    for name in ("validate", "verify", "summary", "project", "audit-public", "conformance", "lineage", "inspect"):
        sub.choices[name].add_argument("--version-member", default="formatVersion", help="the member that names the version of the record format")
    for name in ("pack", "unpack"):
        s = sub.add_parser(name)
        s.add_argument("source")
        s.add_argument("target")
    s = sub.add_parser("process-template")
    s.add_argument("operation", choices=PROCESSES)
    s.add_argument("--operations", required=True)
    s.add_argument("--inputs", nargs="+", required=True)
    s = sub.add_parser("process-check")
    s.add_argument("path")
    s.add_argument("--schemas", required=True)
    s.add_argument("--schema-id", required=True, help="$id of the schema of requests")
    sub.add_parser("schema-list").add_argument("schemas")
    sub.add_parser("capabilities")
    s = sub.add_parser("schema-show")
    s.add_argument("schemas")
    s.add_argument("id")
    for name in sub.choices:
        sub.choices[name].add_argument("--root", dest="roots", action="append", help="a folder that every path must lie in, links followed; several may be given")
    for name in (*JUDGES, "summary", "project", "lineage"):
        sub.choices[name].add_argument("--out", help="a new folder for the rows, as JSON lines, instead of printing them")
    try:
        a = p.parse_args(argv)
        if getattr(a, "schemas", None) and "schema_id" in a and not a.schema_id:
            p.error("--schemas needs --schema-id")
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        confine(a)
        return run(a)
    except Exception as e:  # never shows a path or a value
        print(json.dumps({"code": getattr(e, "code", "IO_FAILURE")}), file=sys.stderr)
        return 3


def confine(a) -> None:
    """Where roots are given, every path of a command becomes its real path, and must lie below one of them."""
    from tracewell.sources.roots import confined

    for name in ("path", "source", "target", "schemas", "out") if a.roots else ():
        if getattr(a, name, None) is not None:
            setattr(a, name, confined(getattr(a, name), a.roots))


def schemas_of(folder: str) -> dict[str, dict]:
    """The schema documents below a folder, by $id."""
    from tracewell.sources.strict_json import parse

    out = {}
    for top, _, files in os.walk(folder):
        for name in sorted(f for f in files if f.endswith(".json")):
            with open(os.path.join(top, name), encoding="utf-8") as f:
                document = parse(f.read())
            if isinstance(document, dict) and isinstance(document.get("$id"), str):
                out[document["$id"]] = document
    return out


def capabilities() -> dict:
    from dataclasses import asdict

    from tracewell.operators import lineage, records as rec
    from tracewell.sources import bundles, strict_json

    limits = {k: v for k, v in asdict(bundles.Limits()).items() if isinstance(v, int)} | {"record": strict_json.LARGEST_RECORD, "json_depth": strict_json.DEPTH, "lineage_depth": lineage.GREATEST_DEPTH}
    return {"version": rec.Vocabulary.version, "classes": CLASSES, "processes": PROCESSES, "limits": limits}


def run(a) -> int:
    from tracewell.sources import bundles

    if a.command == "capabilities":
        print(json.dumps(capabilities()))
        return 0
    if a.command in ("schema-list", "schema-show"):
        known = schemas_of(a.schemas)
        for line in sorted(known) if a.command == "schema-list" else [known[a.id]] if a.id in known else []:
            print(json.dumps(line))
        return 2 if a.command == "schema-show" and a.id not in known else 0
    if a.command == "process-template":
        from tracewell.operators.records import Vocabulary
        from tracewell.plans import processing

        print(json.dumps(processing.request(Vocabulary("", a.operations), a.operation, a.inputs, {})))
        return 0
    if a.command == "pack":
        bundles.pack(a.source, a.target)
        return 0
    if a.command == "unpack":
        bundles.unpack(a.source, a.target)
        return 0
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tracewell.operators import checks, lineage, public, records as rec, schema
    from tracewell.plans import processing, validation, verification
    from tracewell.sources import strict_json

    spark = SparkSession.builder.getOrCreate()
    structure = {"schemas": schemas_of(a.schemas), "schema_id": a.schema_id} if getattr(a, "schemas", None) else {}
    if a.command in ("inspect", "verify"):  # a folder with a manifest is a bundle; else its ZIP files are
        limits = bundles.Limits(version_member=a.version_member)
        b = bundles.folder_bundle(spark, a.path, "", limits) if os.path.isfile(os.path.join(a.path, "manifest.json")) else bundles.zip_bundles(spark, a.path, limits)
    if a.command == "inspect":
        found = bundles.manifest_findings(bundles.declared_files(b.manifest), b.entries)
        found = found.unionByName(bundles.reference_findings(b.manifest)).drop("bundle")
    elif a.command == "verify":
        found = verification.verify(b, rec.Vocabulary(a.relations, a.operations, a.version_member), **structure, receipt_schema_id=a.receipt_schema_id).drop("bundle")
    elif a.command == "process-check":
        found = schema.validate(strict_json.read_records(spark, a.path), schemas_of(a.schemas), a.schema_id)
    else:
        words = rec.Vocabulary(a.relations, a.operations, a.version_member)
        rows = strict_json.read_records(spark, a.path)
        if a.command == "validate":
            found = validation.diagnose(rows, words, **structure)
        elif a.command == "summary":
            found = rec.summary(rec.facts(rows, words, ["record"]))
        elif a.command == "project":
            found = public.projections(rows, words, set(a.include))
        elif a.command == "audit-public":
            found = validation.audit(rows, words, **structure)
        elif a.command == "conformance":
            diagnostics = validation.diagnose(rows, words, **structure)
            profiles = F.from_json(F.get_json_object("raw", "$.profiles"), "array<string>")
            found = processing.artifact_status(checks.verdicts(rows, diagnostics, "record_key"), rows.select("record_key", profiles.alias("profiles")), a.kind)
        else:
            f = rec.facts(rows, words, ["entity", "relation"])
            entities = f.where("kind = 'entity'").select("record_key", "id", F.col("a").alias("collection"), F.col("b").alias("type"), "path", "place")
            roots = rows.select("record_key", F.lit(a.root).alias("id"))
            found, _, missing = lineage.report(entities, rec.lineage_edges(f, words), roots, a.direction, a.depth)
            if not missing.count() < rows.count():  # no record has it
                raise lineage.LineageError("LINEAGE_ENTITY_MISSING", "no record has this entity")
    failed = F.col("status") == "failed" if a.command == "conformance" else F.lit(True)
    if a.out:
        try:
            found.write.mode("errorifexists").json(a.out)
        except AnalysisException as e:
            e.code = "OUTPUT_EXISTS" if e.getCondition() == "PATH_ALREADY_EXISTS" else "IO_FAILURE"
            raise
        return int(a.command in JUDGES and not spark.read.schema(found.schema).json(a.out).where(failed).isEmpty())
    n = 0
    for line in found.toJSON().toLocalIterator():
        print(line)
        n += a.command != "conformance" or json.loads(line)["status"] == "failed"
    return int(n > 0 and a.command in JUDGES)


if __name__ == "__main__":
    sys.exit(main())
