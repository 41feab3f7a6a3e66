"""Requests for processing by an external engine: composed, checked against a corpus, never performed."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.records import PROCESSING, Vocabulary

DETERMINISM = ("require-deterministic", "require-seeded", "accept-nondeterministic")
#: Which profile an artifact must declare to be checked for a class of implementations.
CLASSES = {"reader": "core", "writer": "core", "transformer": "transformation", "agent-host": "agent", "publisher": "publication"}


class PlanError(ValueError):
    code = "INPUT_INVALID"


def request(words: Vocabulary, operation: str, inputs: list[str], parameters: dict, determinism: str = DETERMINISM[2], most_outputs: int = 16) -> dict:
    """An engine-neutral request document."""
    if operation not in PROCESSING or determinism not in DETERMINISM or not inputs or most_outputs < 1:
        raise PlanError("operation, determinism, inputs or the number of outputs are not allowed")
    return {
        "id": f"urn:uuid:{uuid.uuid4()}", "createdAt": datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"),
        "operationType": f"{words.operations}.{operation}", "inputs": list(inputs), "parameters": parameters, "determinism": determinism,
        "policyRefs": [], "outputContract": {"roles": ["derivative"], "maxOutputs": most_outputs}, "extensions": {},
    }


def unresolved_inputs(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_key, code, instance_path) of inputs (record_key, place, id) that are no representation of their record."""
    works = facts.where("kind = 'entity' AND a = 'representations'").select("record_key", "id").distinct()
    return wanted.join(works, ["record_key", "id"], "left_anti").select("record_key", F.lit("UNRESOLVED_REF").alias("code"), F.concat(F.lit("/inputs/"), F.col("place")).alias("instance_path"))


def artifact_status(verdicts: DataFrame, declared: DataFrame, kind: str) -> DataFrame:
    """(record_key, status) for a class: partial if a record is valid and declares the class's profile, else failed. One
    artifact never proves more. declared: (record_key, profiles)."""
    has = F.array_contains("profiles", CLASSES[kind])
    ok = F.coalesce(F.col("valid") & has, F.lit(False))
    return verdicts.join(declared, "record_key", "left").select("record_key", F.when(ok, "partial").otherwise("failed").alias("status"))
