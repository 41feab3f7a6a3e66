"""Validation of a corpus in phases: parsing, structure, profiles, semantics. A record that fails a phase enters no later one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import checks, profiles, public, records as rec, schema
from tracewell.operators.workspace import materialized
from tracewell.sources import strict_json


def diagnose(records: DataFrame, words: rec.Vocabulary, schemas: dict[str, dict] | None = None, schema_id: str | None = None) -> DataFrame:
    """(record_key, code, severity, instance_path) of records (record_key, raw). Records whose structure is invalid and that
    name another version of the format are told so."""
    if schemas is not None:
        first = schema.validate(records, schemas, schema_id).select("record_key", "code", F.lit("error").alias("severity"), "instance_path")
    else:
        first = strict_json.verdicts(records).select("record_key", "code", F.lit("error").alias("severity"), F.col("pointer").alias("instance_path"))
    first = materialized(first, "structure")
    sound = records.join(first.select("record_key").distinct(), "record_key", "left_anti")
    members = F.from_json("raw", "map<string,string>")
    other = F.map_contains_key(members, words.version_member) & ~members[words.version_member].eqNullSafe(F.lit(words.version))
    old = records.join(first.where("code = 'SCHEMA_INVALID'").select("record_key").distinct(), "record_key", "left_semi").where(other)
    old = rec.diagnostic(old, "UNSUPPORTED_VERSION", F.lit(f"/{words.version_member}"))
    f = rec.facts(sound, words)  # profiles and rules read the same facts
    shape = profiles.check(f).select("record_key", "code", F.lit("error").alias("severity"), F.lit("/profiles").alias("instance_path"))
    return first.unionByName(old).unionByName(shape).unionByName(rec.findings(f, words)).distinct()


def audit(records: DataFrame, words: rec.Vocabulary, schemas: dict[str, dict] | None = None, schema_id: str | None = None) -> DataFrame:
    """(record_key, code, instance_path) of what forbids publishing records (record_key, raw) as they are. With schemas, their
    structure comes first, and a record that fails it is told only that."""
    if schemas is None:
        return public.audits(records, words)
    first = materialized(schema.validate(records, schemas, schema_id).select("record_key", "code", "instance_path"), "audit-structure")
    sound = records.join(first.select("record_key").distinct(), "record_key", "left_anti")
    return first.unionByName(public.audits(sound, words))


def verdicts(records: DataFrame, words: rec.Vocabulary, **structure) -> DataFrame:
    return checks.verdicts(records, diagnose(records, words, **structure), "record_key")
