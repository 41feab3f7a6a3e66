"""Strict JSON: what Spark's own parsers accept and a record store must not.

Duplicate member names, prototype keys, more than DEPTH levels, anything after the value, and numbers beyond a double are
errors, each with a code and the JSON Pointer of where it happened. The scanner keeps its own stack, so depth costs no
recursion.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 512
LARGEST_RECORD = 16 * 1024 * 1024
_SPACE = re.compile(r"[ \n\r\t]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"')
_ATOM = re.compile(r"(?P<n>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}
#: Whole doubles, as json writes them; and characters that UTF-16 sorts otherwise than code points.
_WHOLE = re.compile(r"(?:^|[:,\[])-?(?:[0-9]+\.0(?![0-9])|[0-9.]+e\+)")
_BEYOND = re.compile("[\ud800-\U0010ffff]")


class JsonError(ValueError):
    def __init__(self, code: str, pointer: str):
        super().__init__(code)
        self.code, self.pointer = code, pointer


def segment(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _number(text: str) -> int | float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(text)
    return int(value) if value.is_integer() and abs(value) <= 2**53 else value


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs) or "__proto__" in out:
        raise ValueError("key")
    return out


def _refused(text: str):
    raise ValueError(text)


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_float=_number, parse_int=_number, parse_constant=_refused)
_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _too_deep(value) -> bool:
    level = [value] if isinstance(value, dict | list) else []
    for _ in range(DEPTH):
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v) if isinstance(x, dict | list)]
        if not level:
            return False
    return True


def parse(text: str):
    """The value of a JSON text; objects are dicts in the order of the text. Numbers with a fraction or an exponent, and
    whole numbers beyond 2**53, are doubles. Python's own decoder reads sound texts; what it refuses is scanned for the
    place and the code of the fault."""
    try:
        value = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return scan(text)
    return scan(text) if text.count("{") + text.count("[") > DEPTH and _too_deep(value) else value


def scan(text: str):
    """parse(), a token at a time."""
    stack: list = []  # of [container, pointer, key]
    at, root = _SPACE.match(text, 0).end(), None
    want = "value"

    def here() -> str:
        if not stack:
            return ""
        box, pointer, key = stack[-1]
        return f"{pointer}/{len(box)}" if isinstance(box, list) else pointer if key is None else f"{pointer}/{segment(key)}"

    def fail(code: str = "JSON_SYNTAX", pointer: str | None = None):
        raise JsonError(code, here() if pointer is None else pointer)

    while want != "end":
        c = text[at : at + 1]
        if want in ("value", "first item"):
            if want == "first item" and c == "]":
                want = "close"
                continue
            if c in ("{", "["):
                if len(stack) >= DEPTH:
                    fail("JSON_DEPTH")
                stack.append([{} if c == "{" else [], here(), None])
                at += 1
                want = "first key" if c == "{" else "first item"
            else:
                m = _STRING.match(text, at) if c == '"' else _ATOM.match(text, at)
                if not m:
                    fail()
                at = m.end()
                if c == '"':
                    value = json.loads(m[0])
                elif m["n"] is None:
                    value = _WORDS[m[0]]
                else:
                    value = float(m[0])
                    if not math.isfinite(value):
                        fail("JSON_NON_FINITE")
                    if value.is_integer() and abs(value) <= 2**53:
                        value = int(value)
                root, want = _put(stack, value, root)
        elif want in ("key", "first key"):
            if want == "first key" and c == "}":
                want = "close"
                continue
            m = _STRING.match(text, at)
            if not m:
                fail(pointer=stack[-1][1])
            key = json.loads(m[0])
            if key in stack[-1][0]:
                fail("JSON_DUPLICATE_KEY", f"{stack[-1][1]}/{segment(key)}")
            if key == "__proto__":
                fail("JSON_DANGEROUS_KEY", f"{stack[-1][1]}/{segment(key)}")
            stack[-1][2] = key
            at = _SPACE.match(text, m.end()).end()
            if text[at : at + 1] != ":":
                fail()
            at, want = at + 1, "value"
        elif want == "next":
            closing = "]" if isinstance(stack[-1][0], list) else "}"
            if c == ",":
                at, want = at + 1, "value" if closing == "]" else "key"
            elif c == closing:
                want = "close"
                continue
            else:
                fail(pointer=stack[-1][1])
        elif want == "close":
            at += 1
            root, want = _put(stack, stack.pop()[0], root)
        at = _SPACE.match(text, at).end()
    if at != len(text):
        fail(pointer="")
    return root


def _put(stack: list, value, root):
    """Puts a finished value into its container; what is wanted next."""
    if not stack:
        return value, "end"
    box, _, key = stack[-1]
    if isinstance(box, list):
        box.append(value)
    else:
        box[key] = value
        stack[-1][2] = None
    return root, "next"


def stable(value) -> str:
    """JSON with sorted keys and without spaces; -0 is 0, and whole doubles have no fraction."""
    try:
        text = _ENCODER.encode(value)
    except (ValueError, TypeError, RecursionError):
        return written(value)
    whole = (".0" in text or "e+" in text) and _WHOLE.search(text)
    return written(value) if whole or not text.isascii() and _BEYOND.search(text) else text


def written(value) -> str:
    """stable(), a value at a time."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(value[k])}" for k in keys) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(written, value)) + "]"
    if isinstance(value, float) and not isinstance(value, bool):
        if not math.isfinite(value):
            raise JsonError("JSON_NON_FINITE", "")
        if value.is_integer() and abs(value) < 1e21:
            return str(int(value))
    if value is not None and not isinstance(value, bool | int | float | str):
        raise JsonError("JSON_UNSUPPORTED_VALUE", "")
    return json.dumps(value, ensure_ascii=False)


def walk(value) -> Iterator[tuple[str, str | None, object, object]]:
    """Every value in pre-order with sorted keys, as pointer, key, value and parent."""
    stack = [("", None, value, None)]
    while stack:
        pointer, key, v, parent = stack.pop()
        yield pointer, key, v, parent
        if isinstance(v, dict):
            stack += [(f"{pointer}/{segment(k)}", k, v[k], v) for k in sorted(v, reverse=True)]
        elif isinstance(v, list):
            stack += [(f"{pointer}/{k}", str(k), v[k], v) for k in range(len(v) - 1, -1, -1)]


def read_records(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(record_key, raw, code) of the files below a folder: oversized files and invalid UTF-8 have a code and no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    code = F.when(F.col("length") > LARGEST_RECORD, "RECORD_LIMIT").when(~ok, "JSON_SYNTAX")
    raw = F.when(code.isNull(), F.col("content").cast("string"))
    return files.select(F.col("path").alias("record_key"), raw.alias("raw"), code.alias("code"))


def verdicts(records: DataFrame) -> DataFrame:
    """(record_key, code, pointer) of records (record_key, raw) that do not parse."""

    def run(batches):
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    parse(t or "")
                except JsonError as e:
                    out.append((k, e.code, e.pointer))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["record_key", "code", "pointer"])

    return records.select("record_key", "raw").mapInArrow(run, "record_key string, code string, pointer string")


def nodes(records: DataFrame) -> DataFrame:
    """Every value of every record that parses: record_key, place in pre-order, pointer, key, kind, text and number."""

    def run(batches):
        names = ["record_key", "place", "pointer", "key", "kind", "text", "number"]
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()]
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    doc = parse(t or "")
                except JsonError:
                    continue
                for n, (pointer, key, v, _) in enumerate(walk(doc)):
                    kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "null" if v is None else "number"
                    out.append((k, n, pointer, key, kind, v if kind == "string" else None, float(v) if kind == "number" else None))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return records.select("record_key", "raw").mapInArrow(run, "record_key string, place int, pointer string, key string, kind string, text string, number double")
