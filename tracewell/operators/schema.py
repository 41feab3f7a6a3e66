"""A JSON Schema (2020-12) evaluator for the closed keyword set that record schemas use; all errors are reported.

Schemas are documents of the caller's, given as a catalog of id -> schema. Each error is (keyword, instance_path); codes
and paths are stable, wording is not attempted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.workspace import materialized
from tracewell.sources.strict_json import JsonError, parse, segment

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def is_type(value, name: str) -> bool:
    if name == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    if name == "integer":
        return is_type(value, "number") and float(value).is_integer()
    return isinstance(value, _TYPES[name])


def same(a, b) -> bool:
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) and isinstance(a, bool) == isinstance(b, bool)


def _date_time(s: str) -> bool:
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}):(\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})", s)
    if not m or int(m[3]) > 60:
        return False
    try:
        datetime.fromisoformat(f"{m[1]}T{m[2]}:{min(int(m[3]), 59):02d}")
    except ValueError:
        return False
    return m[5] in "Zz" or int(m[5][1:3]) < 24 and int(m[5][4:]) < 60


FORMATS = {
    "date-time": _date_time,
    "date": lambda s: bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", s)) and _date_time(s + "T00:00:00Z"),
    "uri": lambda s: bool(re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*", s)),
    "uri-reference": lambda s: not re.search(r"[\s<>\"{}|\\^`]", s),
    "uuid": lambda s: bool(re.fullmatch(r"(?i)(urn:uuid:)?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", s)),
    "json-pointer": lambda s: bool(re.fullmatch(r"(/([^~/]|~[01])*)*", s)),
    "email": lambda s: bool(re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", s)),
    "hostname": lambda s: len(s) < 254 and bool(re.fullmatch(r"(?!-)[A-Za-z0-9-]{1,63}(?<!-)(\.(?!-)[A-Za-z0-9-]{1,63}(?<!-))*", s)),
}


class Catalog:
    def __init__(self, schemas: dict[str, dict]):
        self.schemas = schemas

    def resolve(self, base: str, ref: str) -> tuple[str, dict]:
        target = base.partition("#")[0] + ref if ref.startswith("#") else urljoin(base, ref)
        document, _, fragment = target.partition("#")
        node = self.schemas.get(document) or next((s for i, s in self.schemas.items() if urlsplit(i).path.rpartition("/")[2] == document.rpartition("/")[2]), None)
        if node is None:
            raise KeyError("SCHEMA_NOT_EMBEDDED")
        for part in fragment.split("/")[1:]:
            node = node[part.replace("~1", "/").replace("~0", "~")] if isinstance(node, dict) else node[int(part)]
        return document, node

    def errors(self, schema_id: str, value) -> list[tuple[str, str]]:
        return sorted(set(self._check(self.schemas[schema_id], value, "", schema_id)))

    def _ok(self, schema, value, base: str) -> bool:
        return next(self._check(schema, value, "", base), None) is None

    def _check(self, s, v, path: str, base: str) -> Iterator[tuple[str, str]]:
        if s is True or s == {}:
            return
        if s is False:
            yield "false", path
            return
        base = urljoin(base, s.get("$id", ""))
        if "$ref" in s:
            document, node = self.resolve(base, s["$ref"])
            yield from self._check(node, v, path, document)
        if "type" in s and not any(is_type(v, t) for t in ([s["type"]] if isinstance(s["type"], str) else s["type"])):
            yield "type", path
            return
        if "const" in s and not same(v, s["const"]):
            yield "const", path
        if "enum" in s and not any(same(v, x) for x in s["enum"]):
            yield "enum", path
        if isinstance(v, str):
            yield from self._string(s, v, path)
        elif isinstance(v, dict):
            yield from self._object(s, v, path, base)
        elif isinstance(v, list):
            yield from self._array(s, v, path, base)
        elif is_type(v, "number"):
            tests = {"minimum": v >= s.get("minimum", v), "maximum": v <= s.get("maximum", v), "exclusiveMinimum": "exclusiveMinimum" not in s or v > s["exclusiveMinimum"], "exclusiveMaximum": "exclusiveMaximum" not in s or v < s["exclusiveMaximum"]}
            yield from ((k, path) for k, ok in tests.items() if not ok)
        for part in s.get("allOf", ()):
            yield from self._check(part, v, path, base)
        if "anyOf" in s and not any(self._ok(x, v, base) for x in s["anyOf"]):
            yield "anyOf", path
        if "oneOf" in s and sum(self._ok(x, v, base) for x in s["oneOf"]) != 1:
            yield "oneOf", path
        if "not" in s and self._ok(s["not"], v, base):
            yield "not", path
        if "if" in s:
            branch = s.get("then" if self._ok(s["if"], v, base) else "else", True)
            yield from self._check(branch, v, path, base)

    def _string(self, s, v: str, path: str):
        if not s.get("minLength", 0) <= len(v) <= s.get("maxLength", len(v)):
            yield "minLength" if len(v) < s.get("minLength", 0) else "maxLength", path
        if "pattern" in s and not re.search(s["pattern"], v):
            yield "pattern", path
        if s.get("format") in FORMATS and not FORMATS[s["format"]](v):
            yield "format", path

    def _object(self, s, v: dict, path: str, base: str):
        for k in s.get("required", ()):
            if k not in v:
                yield "required", f"{path}/{segment(k)}"
        if len(v) < s.get("minProperties", 0):
            yield "minProperties", path
        known, patterns = s.get("properties", {}), s.get("patternProperties", {})
        for k, x in v.items():
            at = f"{path}/{segment(k)}"
            if k in known:
                yield from self._check(known[k], x, at, base)
            hits = [p for p in patterns if re.search(p, k)]
            for p in hits:
                yield from self._check(patterns[p], x, at, base)
            if k not in known and not hits and "additionalProperties" in s:
                if s["additionalProperties"] is False:
                    yield "additionalProperties", at
                else:
                    yield from self._check(s["additionalProperties"], x, at, base)
            if "propertyNames" in s and not self._ok(s["propertyNames"], k, base):
                yield "propertyNames", at

    def _array(self, s, v: list, path: str, base: str):
        if len(v) < s.get("minItems", 0):
            yield "minItems", path
        if len(v) > s.get("maxItems", len(v)):
            yield "maxItems", path
        if s.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in v}) < len(v):
            yield "uniqueItems", path
        first = s.get("prefixItems", [])
        for k, x in enumerate(v):
            yield from self._check(first[k] if k < len(first) else s.get("items", True), x, f"{path}/{k}", base)
        if "contains" in s and sum(self._ok(s["contains"], x, base) for x in v) < s.get("minContains", 1):
            yield "contains", path


_FOUND = "record_key string, code string, keyword string, instance_path string"


def evaluated(records: DataFrame, schemas: dict[str, dict], schema_id: str) -> DataFrame:
    """validate(), by the evaluator alone."""

    def run(batches):
        catalog = Catalog(schemas)
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [(key, "SCHEMA_INVALID", k, p) for k, p in catalog.errors(schema_id, parse(text or ""))]
                except JsonError as e:
                    out.append((key, e.code, "", e.pointer))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["record_key", "code", "keyword", "instance_path"])

    return records.select("record_key", "raw").mapInArrow(run, _FOUND)


def validate(records: DataFrame, schemas: dict[str, dict], schema_id: str) -> DataFrame:
    """(record_key, code, keyword, instance_path) of records (record_key, raw) against a schema; also parse errors. The schema is
    compiled to columns if it can be, and then only texts that columns cannot read for sure go to the evaluator."""
    from tracewell.operators import fact_columns, schema_columns

    if schema_id not in schemas:
        raise KeyError("SCHEMA_UNKNOWN")
    raw, value = F.col("raw"), F.col("value")
    try:
        found = schema_columns.Compiler(schemas).found(schema_id, value)
    except schema_columns.Unsupported:
        return evaluated(records, schemas, schema_id)
    v = schema_columns.Typed(F.col("lean"), fact_columns.Need(), "$[0]")
    try:
        short = schema_columns.Compiler(schemas).found(schema_id, v)
        v.ask("object")
    except schema_columns.Unsupported:
        rows = fact_columns.read(records).withColumn("fit", F.lit(False))
    else:
        columns, fit = fact_columns.taken(raw, v, ["null"])
        rows = records.select("record_key", "raw", *[c.alias(name) for name, c in columns.items()]).withColumn("fit", fit)
        rows = rows.withColumn("value", fact_columns.value(F.when(~F.col("fit"), raw)))
        found = F.when(F.col("fit"), short).otherwise(found)
    rows = rows.withColumn("plain", F.col("fit") | fact_columns.plain(raw, value, words=False))
    rows = rows.select("record_key", "plain", F.explode(F.when(F.col("plain"), found).otherwise(F.array("raw"))).alias("e"))
    rows = materialized(rows, "structure-found")
    told = rows.where("plain").select("record_key", F.lit("SCHEMA_INVALID").alias("code"), *schema_columns.parts(F.col("e")))
    left = rows.where("NOT plain").select("record_key", F.col("e").alias("raw"))
    return told if left.isEmpty() else told.unionByName(evaluated(left, schemas, schema_id))
