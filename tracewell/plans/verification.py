"""Verification of bundles as a whole: entries, manifest, records, event logs, and how they refer to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import records as rec, schema
from tracewell.operators.workspace import materialized
from tracewell.plans import validation
from tracewell.sources import bundles

LOG = "events.ndjson"
_HISTORY = "struct<history: struct<mode: string, href: string, eventIds: array<string>>>"


def _pointer(rows: DataFrame, path: Column | str, code: Column | str, pointer: Column | None = None, severity: Column | None = None) -> DataFrame:
    """rows as findings: where in which file."""
    return rows.select("bundle", F.col(path).alias("path") if isinstance(path, str) else path.alias("path"), (F.lit(code) if isinstance(code, str) else code).alias("code"), (F.lit("error") if severity is None else severity).alias("severity"), (F.lit("") if pointer is None else pointer).alias("pointer"))


def prefixed(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """(bundle, path, code, severity, instance_path): the pointers of findings (.., pointer) inside a file, set behind the
    file's first place in the manifest; a path that it does not list has no place."""
    place = manifest.where("kind = 'file'").groupBy("bundle", "path").agg(F.concat(F.lit("/files/"), F.min("n")).alias("place"))
    at = F.concat(F.coalesce("place", F.lit("")), "pointer")
    return findings.join(place, ["bundle", "path"], "left").select("bundle", "path", "code", "severity", at.alias("instance_path")).distinct()


def ordered(findings: DataFrame) -> DataFrame:
    """Findings by bundle, and then by place and code as English sorts them."""
    return findings.orderBy("bundle", F.collate(F.concat_ws("\0", "instance_path", "code"), "en"), "path", "severity")


def histories(b: bundles.Bundles, records: DataFrame, receipts: DataFrame) -> DataFrame:
    """Findings of the event ids that sound records (bundle, path, raw) declare against the receipts (log, line, id, record_id,
    sequence, code) of their bundle. An event log is shared by the records of a bundle."""
    owners = b.manifest.where("kind = 'record'").select("bundle", "path", F.col("id").alias("record_id"))
    told = records.select("bundle", "path", F.from_json("raw", _HISTORY)["history"].alias("h")).where("h.mode = 'external'")
    told = told.join(owners, ["bundle", "path"]).select("bundle", "path", "record_id", "h.href", "h.eventIds")
    logs = b.manifest.where("role = 'event-log'").select("bundle").distinct()
    history = F.lit("/history")
    out = _pointer(told.join(logs, "bundle", "left_anti"), "path", "BUNDLE_EVENT_LOG_MISSING", history)
    out = out.unionByName(_pointer(told.where(~F.col("href").eqNullSafe(LOG)), "path", "BUNDLE_EVENT_PATH_INVALID", F.concat(history, F.lit("/href"))))
    declared = told.select(F.col("bundle").alias("log"), "record_id", F.explode("eventIds").alias("id"))
    out = out.unionByName(_pointer(bundles.event_closure(declared, receipts).withColumnRenamed("log", "bundle"), F.lit(LOG), F.col("code")))
    known = owners.select(F.col("bundle").alias("log"), "record_id").distinct()
    lost = receipts.where("code IS NULL").join(known, ["log", "record_id"], "left_anti")
    return out.unionByName(_pointer(lost.withColumnRenamed("log", "bundle"), F.lit(LOG), "BUNDLE_EVENT_RECORD_UNRESOLVED", F.concat(F.lit("/"), F.col("line") - 1, F.lit("/recordId"))))


def verify(b: bundles.Bundles, words: rec.Vocabulary, schemas: dict[str, dict] | None = None, schema_id: str | None = None, receipt_schema_id: str | None = None) -> DataFrame:
    """(bundle, path, code, severity, instance_path) of all findings in bundles, in order. Records that have errors declare
    nothing; lines that do not fit the receipt schema, where one is given, count as no receipts."""
    b = bundles.Bundles(*(materialized(t, f"bundle-{k}") for k, t in enumerate((b.entries, b.manifest, b.contents))))
    key = F.concat_ws("!/", "bundle", "path")
    read = b.contents.where("role = 'record'").withColumn("record_key", key)
    sound = read.where("code IS NULL")
    diagnostics = materialized(validation.diagnose(sound.select("record_key", "raw"), words, schemas, schema_id), "bundle-diagnostics")
    valid = sound.join(diagnostics.where("severity = 'error'").select("record_key").distinct(), "record_key", "left_anti")
    lines = b.contents.where(F.col("role") == "event-log").where(F.col("path") == LOG)
    receipts = lines.select(F.col("bundle").alias("log"), "line", "id", "record_id", "sequence", "code", "raw")
    parts = [
        _pointer(bundles.manifest_findings(bundles.declared_files(b.manifest), b.entries), "path", F.col("code")),
        _pointer(bundles.reference_findings(b.manifest, valid.select("bundle", "path", "id")), "path", F.col("code")),
        _pointer(read.where("code IS NOT NULL"), "path", F.col("code")),
        _pointer(diagnostics.join(sound.select("record_key", "bundle", "path"), "record_key"), "path", F.col("code"), F.col("instance_path"), F.col("severity")),
    ]
    if receipt_schema_id is not None:
        named = receipts.where("code IS NULL").select(F.to_json(F.struct("log", "line")).alias("record_key"), "log", "line", "raw")
        bad = materialized(schema.validate(named, schemas, receipt_schema_id).join(named.drop("raw"), "record_key"), "bundle-receipts")
        parts.append(_pointer(bad.withColumnRenamed("log", "bundle"), F.lit(LOG), F.col("code"), F.concat(F.lit("/"), F.col("line") - 1, F.col("instance_path"))))
        receipts = receipts.join(bad.select("log", "line").distinct(), ["log", "line"], "left_anti")
    receipts = receipts.drop("raw")
    found = bundles.receipt_findings(receipts).withColumnRenamed("log", "bundle")
    parts += [_pointer(found, F.lit(LOG), F.col("code"), F.concat(F.lit("/"), F.col("line") - 1)), histories(b, valid, receipts)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return ordered(prefixed(out, b.manifest))
