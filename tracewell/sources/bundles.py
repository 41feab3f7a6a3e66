"""Bundles: folders or ZIP files with a manifest. Their entries as rows, checks of them, and packing.

Contents are hashed where they are read; only sizes, digests and findings move.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.names import fold_path, path_problem
from tracewell.operators import budgets, checks
from tracewell.sources.strict_json import LARGEST_RECORD, JsonError, parse

#: What a bundle may hold.
@dataclass(frozen=True)
class Limits:
    entries: int = 10_000
    total: int = 2 * 1024**3
    entry: int = 512 * 1024**2
    manifest: int = 1024**2
    line: int = 2 * 1024**2
    ratio: int = 100
    #: What a manifest is to call itself (None: anything), and its member that names the version of the record format.
    manifest_type: str | None = None
    version_member: str = "formatVersion"


class BundleError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


ENTRIES = "bundle string, path string, length long, sha256 string, code string"


def zip_entries(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(bundle, path, length, sha256, code) of every file in the ZIP files below a folder. Entries that are encrypted, too
    large, too tightly packed, links or badly named have a code and are not read; so has a file that is no ZIP."""

    def run(batches):
        for b in batches:
            out = []
            for bundle, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += list(list_zip(bundle, content, limits))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["bundle", "path", "length", "sha256", "code"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInArrow(run, ENTRIES)


def entry_problem(info: zipfile.ZipInfo, limits: Limits) -> str | None:
    kind = (info.external_attr >> 16) & 0o170000
    if info.flag_bits & 1:
        return "BUNDLE_ENCRYPTED_ENTRY"
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return "BUNDLE_COMPRESSION_UNSUPPORTED"
    if info.file_size > limits.entry:
        return "BUNDLE_ENTRY_LIMIT"
    if info.file_size and (not info.compress_size or info.file_size / info.compress_size > limits.ratio):
        return "BUNDLE_COMPRESSION_RATIO"
    if kind == 0o120000:
        return "BUNDLE_SYMLINK"
    if kind not in (0, 0o100000, 0o040000):
        return "BUNDLE_NON_REGULAR_FILE"
    return path_problem(info.filename.rstrip("/"))


def list_zip(bundle: str, content: bytes, limits: Limits = Limits()):
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        infos = archive.infolist()
    except (zipfile.BadZipFile, OSError):
        yield bundle, "", None, None, "BUNDLE_ZIP_INVALID"
        return
    if len(infos) > limits.entries:
        yield bundle, "", None, None, "BUNDLE_ENTRY_COUNT_LIMIT"
        return
    if sum(i.file_size for i in infos) > limits.total:
        yield bundle, "", None, None, "BUNDLE_TOTAL_LIMIT"
        return
    for i in infos:
        code = entry_problem(i, limits)
        if i.is_dir() and code is None:
            continue
        digest, size = hashlib.sha256(), 0
        if code is None:
            try:
                with archive.open(i) as f:
                    while part := f.read(1 << 16):
                        digest.update(part)
                        size += len(part)
            except (zipfile.BadZipFile, OSError, EOFError):
                code = "BUNDLE_ZIP_ENTRY_INVALID"
            if code is None and size != i.file_size:
                code = "BUNDLE_ENTRY_SIZE_INVALID"
        yield bundle, i.filename, i.file_size, None if code else digest.hexdigest(), code


def _each(fn: Callable, path: str) -> Column:
    """fn of every path, over Arrow batches."""

    def over(paths: pd.Series) -> pd.Series:
        return paths.map(fn)

    return F.pandas_udf(over, "string")(path)


def _inner(path: str):
    inner = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    base = "/" + path.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    return F.substring(inner, len(base) + 1, 1 << 20)


def walk_fault(files: DataFrame, limits: Limits) -> DataFrame:
    """(path, code): the entry at which a walk of a folder's files (path, length) breaks a limit, one at most. Folders come
    before what lies in them, and siblings by name; both count as entries."""
    folders = files.select(F.explode(checks.path_prefixes(F.col("path"))).alias("path")).distinct().withColumn("length", F.lit(0).cast("long"))
    every = files.select("path", "length").unionByName(folders).withColumn("parts", F.split("path", "/"))
    faults = [
        ("BUNDLE_ENTRY_COUNT_LIMIT", F.col("n") > limits.entries),
        ("BUNDLE_ENTRY_LIMIT", F.col("length") > limits.entry),
        ("BUNDLE_TOTAL_LIMIT", F.col("total") > limits.total),
    ]
    return budgets.first_fault(every, ["parts"], {"n": F.lit(1), "total": F.col("length")}, faults).select("path", "code")


def folder_entries(spark: SparkSession, path: str, bundle: str, limits: Limits = Limits()) -> DataFrame:
    """The same for one folder; hashing stays in the JVM. Sizes are checked before any content is read: too large a file
    has a code and is not read, and a folder over the count or total has only a row that says which a walk meets first
    (folder_fault() names the entry). Folders count as entries where files lie in them. Spark's reader shows neither empty folders nor links, which it may follow."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    sizes = source.load(path).select(_inner(path).alias("path"), "length")
    above = sizes.select(F.explode(checks.path_prefixes(F.col("path"))).alias("path")).distinct().count()
    n, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n + above > limits.entries or total > limits.total:
        fault = walk_fault(sizes, Limits(entries=limits.entries, total=limits.total, entry=1 << 62)).first()
        return spark.createDataFrame([(bundle, "", None, None, fault["code"])], ENTRIES)
    large = sizes.where(F.col("length") > limits.entry).select(F.lit(bundle).alias("bundle"), "path", "length", F.lit(None).cast("string").alias("sha256"), F.lit("BUNDLE_ENTRY_LIMIT").alias("code"))
    read = source.load(path).where(F.col("length") <= limits.entry).select(F.lit(bundle).alias("bundle"), _inner(path).alias("path"), "length", F.sha2("content", 256).alias("sha256"))
    read = read.withColumn("code", _each(path_problem, "path")).withColumn("sha256", F.when(F.col("code").isNull(), F.col("sha256")))
    return read.unionByName(large)


def folder_fault(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """walk_fault() of a folder on disk, without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return walk_fault(files.select(_inner(path).alias("path"), "length"), limits)


MANIFEST = "bundle string, kind string, n int, id string, path string, role string, byte_length long, sha256 string, code string"
_ROLES = {"record", "event-log", "policy", "original", "derivative", "preview", "report", "other"}
_REQUIRED = ("manifestType", "manifestVersion", "id", "createdAt", "createdBy", "disclosure", "profiles", "records", "files", "externalReferences", "omissions", "extensions")


def _whole(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool) and v >= 0 and v == int(v)


def _file_fits(f) -> bool:
    return (
        isinstance(f, dict) and {"path", "role", "mediaType", "byteLength", "sha256", "disclosure"} <= f.keys() <= {"path", "role", "mediaType", "byteLength", "sha256", "disclosure", "recordRef"}
        and all(isinstance(f[k], str) for k in f.keys() - {"byteLength"}) and f["path"] != "" and f["role"] in _ROLES and _whole(f["byteLength"]) and f["byteLength"] < 2**63
        and re.fullmatch("[A-Fa-f0-9]{64}", f["sha256"]) is not None and re.fullmatch("[A-Za-z0-9!#$&^_.+-]+/[A-Za-z0-9!#$&^_.+-]+", f["mediaType"]) is not None
    )


def read_manifest(bundle: str, content: bytes | None, limits: Limits = Limits()) -> list[tuple]:
    """Rows (bundle, kind, n, id, path, role, byte_length, sha256, code) of a manifest: its records and its files in order;
    a file's id is its recordRef. A manifest that does not read has one row of kind manifest, with a code. Of the manifest's
    form its members, its records and its files are checked; the rest is for operators.schema, with the schema given."""
    bad = lambda code: [(bundle, "manifest", 0, None, "manifest.json", None, None, None, code)]
    if content is None or len(content) > limits.manifest:
        return bad("BUNDLE_MANIFEST_LIMIT")
    try:
        m = parse(content.decode("utf-8"))
    except (UnicodeDecodeError, JsonError):
        return bad("BUNDLE_MANIFEST_INVALID_JSON")
    if not isinstance(m, dict) or m.keys() != {*_REQUIRED, limits.version_member} or m["manifestType"] != (limits.manifest_type or m["manifestType"]) or not all(isinstance(m[k], list) for k in ("profiles", "records", "files", "externalReferences", "omissions")) or "core" not in m["profiles"]:
        return bad("SCHEMA_INVALID")
    if not m["records"] or not all(isinstance(r, dict) and r.keys() == {"id", "path"} and all(isinstance(v, str) and v for v in r.values()) for r in m["records"]) or not all(map(_file_fits, m["files"])):
        return bad("SCHEMA_INVALID")
    records = [(bundle, "record", n, r["id"], r["path"], None, None, None, None) for n, r in enumerate(m["records"])]
    return records + [(bundle, "file", n, f.get("recordRef"), f["path"], f["role"], int(f["byteLength"]), f["sha256"], None) for n, f in enumerate(m["files"])]


def _manifest_in_zip(content: bytes, limits: Limits) -> bytes | None:
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("manifest.json") as f:
        return f.read(limits.manifest + 1)


def zip_manifests(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """The rows of the manifests (see read_manifest) in the ZIP files below a folder, and one of kind folder for each directory
    entry. A ZIP whose list or manifest entry is unsound has no rows: zip_entries says why."""

    def run(batches):
        for b in batches:
            out = []
            for bundle, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                    if len(infos) > limits.entries:
                        continue
                    out += [(bundle, "folder", n, None, i.filename.rstrip("/"), None, None, None, None) for n, i in enumerate(infos) if i.is_dir()]
                    if any(i.filename == "manifest.json" and not entry_problem(i, limits) for i in infos):
                        out += read_manifest(bundle, _manifest_in_zip(content, limits), limits)
                except (zipfile.BadZipFile, OSError, EOFError, zlib.error, NotImplementedError):
                    continue
            cols = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=names)

    names = [x.split()[0] for x in MANIFEST.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInArrow(run, MANIFEST)


def folder_manifest(spark: SparkSession, path: str, bundle: str, limits: Limits = Limits()) -> DataFrame:
    """The rows of the manifest of one folder; none if it has no manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").load(path).where(_inner(path) == "manifest.json")
    size = files.select("length").first()
    if size is None:
        return spark.createDataFrame([], MANIFEST)
    content = files.select("content").first()[0] if size[0] <= limits.manifest else None
    return spark.createDataFrame(read_manifest(bundle, None if content is None else bytes(content), limits), MANIFEST)


CONTENTS = "bundle string, path string, role string, line long, raw string, id string, record_id string, sequence long, code string"
_CONTENT_TYPES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
_READ = ("record", "event-log")


def member_rows(bundle: str, path: str, role: str, content: bytes, limits: Limits = Limits()):
    """The rows of CONTENTS of a record (line 0) or of the lines of an event log."""
    if role == "event-log":
        for n, text, code in split_log(content, limits.line):
            yield bundle, path, role, n, text, *receipt_of(text), code
        return
    text = name = code = None
    if len(content) > LARGEST_RECORD:
        code = "RECORD_LIMIT"
    else:
        try:
            text = content.decode("utf-8")
            doc = parse(text)
            name = doc.get("id") if isinstance(doc, dict) else None
        except (UnicodeDecodeError, JsonError):
            text, code = None, "BUNDLE_RECORD_INVALID_JSON"
    yield bundle, path, role, 0, text, name if isinstance(name, str) else None, None, None, code


def _zip_members(bundle: str, content: bytes, limits: Limits):
    """The rows of the records and event logs that the manifest in a ZIP lists; unsound entries have none."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        infos = {i.filename: i for i in archive.infolist()}
        if len(archive.infolist()) > limits.entries or "manifest.json" not in infos or entry_problem(infos["manifest.json"], limits):
            return
        listed = {path: role for _, kind, _, _, path, role, *_ in read_manifest(bundle, _manifest_in_zip(content, limits), limits) if kind == "file" and role in _READ}
    except (zipfile.BadZipFile, OSError, EOFError, zlib.error, NotImplementedError):
        return
    for path, role in listed.items():
        if path in infos and not entry_problem(infos[path], limits):
            try:
                body = archive.read(infos[path])
            except (zipfile.BadZipFile, OSError, EOFError, zlib.error, NotImplementedError):
                continue
            yield from member_rows(bundle, path, role, body, limits)


def _contents(files: DataFrame, rows: Callable) -> DataFrame:
    """The rows of CONTENTS that rows(file) gives, a file at a time."""
    names = [x.split()[0] for x in CONTENTS.split(", ")]

    def run(batches):
        for b in batches:
            for file in zip(*[b.column(k).to_pylist() for k in range(b.num_columns)], strict=True):
                cols = list(zip(*rows(*file), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CONTENT_TYPES, strict=True)], names=names)

    return files.mapInArrow(run, CONTENTS)


@dataclass(frozen=True)
class Bundles:
    """What is read of bundles: their entries (ENTRIES), manifests (MANIFEST), and listed records and logs (CONTENTS)."""

    entries: DataFrame
    manifest: DataFrame
    contents: DataFrame


def zip_bundles(spark: SparkSession, path: str, limits: Limits = Limits()) -> Bundles:
    """The bundles in the ZIP files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return Bundles(zip_entries(spark, path, limits), zip_manifests(spark, path, limits), _contents(files, lambda b, c: _zip_members(b, c, limits)))


def folder_bundle(spark: SparkSession, path: str, bundle: str, limits: Limits = Limits()) -> Bundles:
    """The bundle that a folder is."""
    manifest = folder_manifest(spark, path, bundle, limits)
    listed = F.broadcast(manifest.where(F.col("role").isin(*_READ)).select("bundle", "path", "role").distinct())  # of a manifest of at most limits.manifest bytes
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= limits.entry).select(_inner(path).alias("path"), "content")
    files = files.join(listed, "path").select("bundle", "path", "role", "content")
    return Bundles(folder_entries(spark, path, bundle, limits), manifest, _contents(files, lambda *file: member_rows(*file, limits)))


def declared_files(manifest: DataFrame) -> DataFrame:
    """The files of manifests, as manifest_findings takes them."""
    return manifest.where("kind = 'file'").select("bundle", "path", "byte_length", "sha256")


def reference_findings(manifest: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(bundle, code, path): the records of manifests against their files, and, with documents (bundle, path, id), against the
    ids that the record files hold; their event logs; and directory entries that no file lies in."""
    bad = manifest.where("code IS NOT NULL").select("bundle", "code", "path")
    records, files = manifest.where("kind = 'record'"), manifest.where("kind = 'file'")
    out = [bad]

    def add(rows: DataFrame, code: str) -> None:
        out.append(rows.select("bundle", F.lit(code).alias("code"), "path"))

    for column, code in (("id", "DUPLICATE_ID"), ("path", "BUNDLE_DUPLICATE_PATH")):
        twice = checks.repeated(records, ["bundle", column], [F.col("n")])
        add(twice, code)
        add(twice, "BUNDLE_RECORD_REFERENCE_DUPLICATE")
    last = files.groupBy("bundle", "path").agg(F.max_by("role", "n").alias("file_role"), F.max_by("id", "n").alias("ref"))
    met = records.join(last, ["bundle", "path"], "left")
    add(met.where(~F.col("file_role").eqNullSafe("record")), "BUNDLE_RECORD_REFERENCE_INVALID")
    add(met.where("ref <> id"), "BUNDLE_RECORD_REFERENCE_MISMATCH")
    add(files.where("role = 'record'").join(records.select("bundle", "path"), ["bundle", "path"], "left_anti"), "BUNDLE_RECORD_UNREFERENCED")
    add(checks.unresolved(files, records, ["bundle", "id"]), "UNRESOLVED_REF")
    logs = files.where("role = 'event-log'")
    add(logs.where("path <> 'events.ndjson'"), "BUNDLE_EVENT_PATH_INVALID")
    add(checks.repeated(logs, ["bundle"], [F.col("n")]), "BUNDLE_EVENT_LOG_DUPLICATE")
    if documents is not None:
        held = documents.select("bundle", "path", F.col("id").alias("held"))
        add(records.join(held, ["bundle", "path"]).where(~F.col("held").eqNullSafe(F.col("id"))), "BUNDLE_RECORD_ID_MISMATCH")
    above = files.select("bundle", F.explode(checks.path_prefixes(F.col("path"))).alias("path")).distinct()
    read = files.select("bundle").unionByName(records.select("bundle")).distinct()
    add(manifest.where("kind = 'folder'").join(read, "bundle", "left_semi").join(above, ["bundle", "path"], "left_anti"), "BUNDLE_UNMANIFESTED_ENTRY")
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.distinct()


def manifest_findings(declared: DataFrame, entries: DataFrame) -> DataFrame:
    """(bundle, code, path): declared (bundle, path, byte_length, sha256) against the entries found. The manifest lists all
    files but itself."""
    found = entries.where("code IS NULL AND path <> 'manifest.json'")
    bad = entries.where("code IS NOT NULL").select("bundle", "code", "path")
    missing = checks.uncovered(declared, found, ["bundle", "path"]).select("bundle", F.lit("BUNDLE_COVERAGE_MISMATCH").alias("code"), "path")
    itself = declared.where("path = 'manifest.json'").select("bundle", F.lit("BUNDLE_MANIFEST_SELF_LISTED").alias("code"), "path")
    both = declared.select("bundle", "path", "byte_length", F.col("sha256").alias("declared")).join(found, ["bundle", "path"])
    size = both.where("byte_length <> length").select("bundle", F.lit("BUNDLE_SIZE_MISMATCH").alias("code"), "path")
    digest = both.where(F.lower("declared") != F.lower("sha256")).select("bundle", F.lit("BUNDLE_DIGEST_MISMATCH").alias("code"), "path")
    twice = checks.repeated(declared, ["bundle", "path"], [F.col("byte_length"), F.col("sha256")]).select("bundle", F.lit("BUNDLE_DUPLICATE_PATH").alias("code"), "path")
    none = entries.groupBy("bundle").agg(F.bool_or(F.col("path") == "manifest.json").alias("has")).where("NOT has").select("bundle", F.lit("BUNDLE_MANIFEST_MISSING").alias("code"), F.lit("manifest.json").alias("path"))
    out = bad
    for part in (missing, itself, size, digest, twice, none, path_collisions(found)):
        out = out.unionByName(part)
    return out.distinct()


def path_collisions(entries: DataFrame) -> DataFrame:
    """Entries that, folded, equal another's path or are an ancestor of it."""
    e = entries.select("bundle", "path", _each(fold_path, "path").alias("folded"))
    same = checks.repeated(e, ["bundle", "folded"], [F.col("path")]).select("bundle", "path")
    above = e.select("bundle", F.explode(checks.path_prefixes(F.col("folded"))).alias("folded")).distinct()
    files = e.join(above, ["bundle", "folded"], "left_semi").select("bundle", "path")
    return same.unionByName(files).select("bundle", F.lit("BUNDLE_PATH_COLLISION").alias("code"), "path")


def split_log(content: bytes, limit: int = Limits.line):
    """(line, text, code) of an NDJSON log: CR LF ends count as LF; blank, oversized, and unfinished last lines have codes."""
    lines = content.split(b"\n")
    last = lines.pop()
    for n, raw in enumerate(lines + ([last] if last else []), 1):
        if n > len(lines):
            yield n, None, "BUNDLE_EVENT_PARTIAL_FINAL_LINE"
            continue
        body = raw.removesuffix(b"\r")
        if len(body) > limit:
            yield n, None, "BUNDLE_EVENT_LINE_LIMIT"
        elif not body.strip():
            yield n, None, "BUNDLE_EVENT_BLANK_LINE"
        else:
            try:
                text = body.decode("utf-8")
                parse(text)
                yield n, text, None
            except (UnicodeDecodeError, JsonError):
                yield n, None, "BUNDLE_EVENT_INVALID_JSON"


def receipt_of(text: str | None) -> tuple[str | None, str | None, int | None]:
    """id, recordId and sequence of a line of a log; null where the line has none of the right type."""
    v = parse(text) if text is not None else None
    v = v if isinstance(v, dict) else {}
    number = v.get("sequence")
    words = [v[k] if isinstance(v.get(k), str) else None for k in ("id", "recordId")]
    return *words, number if isinstance(number, int) and not isinstance(number, bool) else None


def read_receipts(spark: SparkSession, path: str, pattern: str = "*.ndjson") -> DataFrame:
    """(log, line, id, record_id, sequence, code) of every line of the logs below a folder."""
    names = ["log", "line", "id", "record_id", "sequence", "code"]

    def run(batches):
        for b in batches:
            out = []
            for log, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(log, n, *receipt_of(text), code) for n, text, code in split_log(content)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(run, "log string, line long, id string, record_id string, sequence long, code string")


def receipt_findings(receipts: DataFrame) -> DataFrame:
    """(log, code, line): lines that do not read, ids seen before, and sequences not above the valid receipt before."""
    valid = receipts.where("code IS NULL")
    bad = receipts.where("code IS NOT NULL").select("log", "code", "line")
    twice = checks.repeated(valid.where("id IS NOT NULL"), ["log", "id"], [F.col("line")]).select("log", F.lit("BUNDLE_EVENT_DUPLICATE_ID").alias("code"), "line")
    order = checks.not_rising(valid, ["log"], [F.col("line")], "sequence", "previous").select("log", F.lit("BUNDLE_EVENT_SEQUENCE").alias("code"), "line")
    return bad.unionByName(twice).unionByName(order)


def event_closure(declared: DataFrame, receipts: DataFrame) -> DataFrame:
    """(log, code, id): events that records declare (log, record_id, id) against the receipts of their log."""
    valid = receipts.where("code IS NULL AND id IS NOT NULL")
    n = valid.groupBy("log", "id").agg(F.count(F.lit(1)).alias("n"), F.max_by("record_id", "line").alias("owner"))
    first = declared.withColumn("_n", F.row_number().over(Window.partitionBy("log", "id").orderBy("record_id")))
    twice = first.where("_n > 1").select("log", F.lit("BUNDLE_EVENT_DECLARATION_DUPLICATE").alias("code"), "id")
    met = declared.join(n, ["log", "id"], "left")
    loose = met.where(~F.coalesce(F.col("n") == 1, F.lit(False))).select("log", F.lit("BUNDLE_EVENT_CLOSURE").alias("code"), "id")
    other = met.where(F.col("n").isNotNull() & ~F.col("owner").eqNullSafe(F.col("record_id"))).select("log", F.lit("BUNDLE_EVENT_RECORD_MISMATCH").alias("code"), "id")
    extra = valid.select("log", "id").distinct().join(declared.select("log", "id"), ["log", "id"], "left_anti").select("log", F.lit("BUNDLE_EVENT_UNDECLARED").alias("code"), "id")
    return twice.unionByName(loose).unionByName(other).unionByName(extra).distinct()


def pack(folder: str, target: str, level: int = 9) -> None:
    """A ZIP of a folder, the same bytes for the same files: sorted paths, one date, plain modes. Never overwrites."""
    if not 0 <= level <= 9:
        raise BundleError("BUNDLE_COMPRESSION_LEVEL_INVALID")
    if os.path.exists(target):
        raise BundleError("BUNDLE_DESTINATION_EXISTS")
    if os.path.realpath(target).startswith(os.path.realpath(folder) + os.sep):
        raise BundleError("BUNDLE_DESTINATION_INSIDE_SOURCE")
    paths = []
    for top, folders, files in os.walk(folder):
        for name in folders + files:
            full = os.path.join(top, name)
            if os.path.islink(full):
                raise BundleError("BUNDLE_SYMLINK")
        paths += [os.path.relpath(os.path.join(top, f), folder).replace(os.sep, "/") for f in files]
    if any(map(path_problem, paths)):
        raise BundleError(next(filter(None, map(path_problem, paths))))
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(target)))
    try:
        with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
            for p in sorted(paths):
                info = zipfile.ZipInfo(p, (1980, 1, 1, 0, 0, 0))
                info.external_attr, info.compress_type, info.create_system = 0o100644 << 16, zipfile.ZIP_DEFLATED, 3
                with open(os.path.join(folder, p), "rb") as source:
                    z.writestr(info, source.read())
        os.link(part, target)
    except FileExistsError as e:
        raise BundleError("BUNDLE_DESTINATION_EXISTS") from e
    finally:
        os.unlink(part)


def unpack(source: str, target: str, limits: Limits = Limits()) -> None:
    """Extracts a checked ZIP into a new folder; on any finding nothing is left behind."""
    if os.path.lexists(target):
        raise BundleError("BUNDLE_DESTINATION_EXISTS")
    with open(source, "rb") as f:
        content = f.read()
    if problem := next((code for *_, code in list_zip(source, content, limits) if code), None):
        raise BundleError(problem)
    with tempfile.TemporaryDirectory(dir=os.path.dirname(os.path.abspath(target))) as part:
        inner = os.path.join(part, "bundle")
        os.mkdir(inner)
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                full = os.path.join(inner, *i.filename.rstrip("/").split("/"))
                os.makedirs(full if i.is_dir() else os.path.dirname(full), exist_ok=True)
                if not i.is_dir():
                    with open(full, "xb") as out:
                        out.write(z.read(i))
        os.rename(inner, target)
