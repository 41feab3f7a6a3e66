"""Substring dedup by unit hashing.

Units are paragraphs (between blank lines), lines, and passages: every window of WINDOW words. A unit is normalised (lower
case, single spaces) and hashed to 128 bits. Digests are grouped globally; the occurrence that comes first, by id and then
by place, is kept, and every other is removed: its own span and nothing else, in characters of the original text. Spans that
touch or overlap are one.

Every paragraph counts, whatever its length, and so does every line of line_words words or more (LINE_WORDS, unless the
caller says otherwise; 1: all lines): shorter lines are shared by texts that have nothing else in common, and line dedup is the
operator for them. Lines and paragraphs alone would miss a
passage that starts or ends inside a line; windows find each that has WINDOW words, wherever it starts.

Not every window is hashed. By winnowing each window names its least GRAM-gram as its anchor; equal windows name equal
anchors. The windows that name one anchor follow one another; together they are its context. Anchors met once are left. Of
equal contexts all but the first go, as each of their windows is in the first. Windows are hashed only in the first of each
context, and only where an anchor has several contexts. These are lossless filters.

Defined results: a null or empty text has no units. Rows with a null id are not compared, and stay. Rows that repeat an id
and its text are one text: both keep or lose a unit alike. Rows that share an id but not the text are different texts, in the
order of their hashes. An empty table gives no spans.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SLICE, column_name, give_back, looked_up, mapped, saved, small_side

WINDOW, GRAM = 51, 25
LINE_WORDS = 20
#: Bytes of words whose digests a task remembers, by estimate.
KNOWN_BYTES = 16_000_000
#: Bytes of a table of digests that is broadcast. Such tables grow with the corpus, so they are shuffled at every other size.
DIGESTS = 1 << 20
#: Windows that are hashed before they are sent on.
SENT = 20_000
_BLANK = re.compile(r"\n[ \t\x0b\f\r]*\n\s*")
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PARAGRAPH, LINE, ANCHOR = 0, 1, 2
#: What one reading of a text gives: units (h1 and h2 are the digest), and anchors (their hash and that of their context).
FOUND = "kind int, at int, h1 long, h2 long, start int, stop int"


class Words(dict):
    """Word, as UTF-8 -> digest of the word in lower case; remembered."""

    held = 0

    def __missing__(self, w: bytes) -> bytes:
        d = self[w] = xxhash.xxh3_128_digest(w.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass"))
        self.held += 2 * len(w) + 200
        return d

    def of(self, text: str) -> bytes:
        """16 bytes for each word of a text."""
        if self.held > KNOWN_BYTES:
            self.clear()
            self.held = 0
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))  # bytes split at SEPARATORS only


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each word."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = (codes != 0x20) & ((codes < 0x09) | (codes > 0x0D))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1).astype(np.int32), np.flatnonzero(edge == -1).astype(np.int32)


def blocks(text: str) -> list[tuple[int, int, int]]:
    """Kind, start and stop of each paragraph and each line; a paragraph's line breaks count as spaces."""
    out, at = [], 0
    for m in [*_BLANK.finditer(text), None]:
        out.append((PARAGRAPH, at, m.start() if m else len(text)))
        at = m.end() if m else at
    at = 0
    for line in text.split("\n"):
        out.append((LINE, at, at + len(line)))
        at += len(line) + 1
    return out


def units(text: str, digests: bytes, start: np.ndarray, stop: np.ndarray, line_words: int = LINE_WORDS) -> list[tuple]:
    """FOUND of each paragraph with a word and each line of line_words words."""
    out = []
    for kind, a, b in blocks(text):
        i, j = np.searchsorted(start, [a, b]).tolist()
        if j - i >= (line_words if kind == LINE else 1):
            d = xxhash.xxh3_128_intdigest(digests[16 * i : 16 * j], seed=kind)
            out.append((kind, i, (d >> 64) - 2**63, (d & 2**64 - 1) - 2**63, int(start[i]), int(stop[j - 1])))
    return out


def anchors(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the number of the word where its least gram starts; and the hash of each gram."""
    if len(digests) < 16 * WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part, f, size = np.frombuffer(digests, np.uint64)[::2], _FACTOR, 1
    g, done = None, 0
    n = len(part) - GRAM + 1
    while size <= GRAM:
        if GRAM & size:
            g = part[:n] if g is None else g * f + part[done : done + n]
            done += size
        part = part[: len(part) - size] * f + part[size:]
        f, size = f * f, 2 * size
    g = g ^ (g >> np.uint64(32))
    g *= _MIX
    g ^= g >> np.uint64(32)
    least = np.lib.stride_tricks.sliding_window_view(g, WINDOW - GRAM + 1).argmin(axis=1)
    return least + np.arange(len(least)), g.view(np.int64)


def contexts(digests: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """FOUND, as columns, of each anchor."""
    named, grams = anchors(digests)
    low = np.flatnonzero(np.diff(named, prepend=-1))
    high = np.append(low[1:], len(named)) - 1 + WINDOW
    view = memoryview(digests)
    whole = np.fromiter((xxhash.xxh3_64_intdigest(view[16 * i : 16 * j]) for i, j in zip(low.tolist(), high.tolist(), strict=True)), np.uint64, len(low)).view(np.int64)
    at = named[low]
    return np.full(len(at), ANCHOR, np.int32), at.astype(np.int32), grams[at], whole, start[low], stop[high - 1]


def texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, v (a hash that tells texts of one id apart) and text of the rows that are compared."""
    t = F.col(text).cast("string")
    return docs.where(F.col(key).isNotNull() & t.isNotNull()).select(F.col(key).alias("id"), F.xxhash64(t).alias("v"), t.alias("text"))


def _reading(plain: DataFrame, line_words: int = LINE_WORDS) -> DataFrame:
    """id, v and FOUND of each unit and each anchor."""
    schema = StructType([*plain.schema.fields[:2], *StructType.fromDDL(FOUND).fields])
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        words = Words()
        with np.errstate(over="ignore"):
            for b in batches:
                for first in range(0, b.num_rows, SLICE):
                    part = b.slice(first, SLICE)
                    owner, cols = [], []
                    for k, t in enumerate(part.column(2).to_pylist()):
                        digests = words.of(t)
                        if not digests:
                            continue
                        start, stop = places(t)
                        cols.append([*map(np.array, zip(*units(t, digests, start, stop, line_words), strict=True))])
                        cols.append(contexts(digests, start, stop) if len(start) >= WINDOW else [()] * 6)
                        owner.append(np.full(len(cols[-2][0]) + len(cols[-1][0]), k, np.int32))
                    if owner:
                        at = pa.array(np.concatenate(owner))
                        made = [pa.array(np.concatenate([np.asarray(c[k], t.to_pandas_dtype()) for c in cols]), t) for k, t in enumerate(types)]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *made], names=schema.names)
        words.clear()
        give_back()

    return mapped(plain, run, schema)


def _windows(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, v, at, start, stop, h1, h2) of each window that names an anchor of wanted (id, v, ats)."""
    schema = StructType([*plain.schema.fields[:2], *StructType.fromDDL("at int, start int, stop int, h1 long, h2 long").fields])
    few = 32

    def run(batches):
        words = Words()
        with np.errstate(over="ignore"):
            for b in batches:
                for first in range(0, b.num_rows, few):
                    part = b.slice(first, few)
                    for k, (t, ats) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                        digests = words.of(t)
                        at = np.flatnonzero(np.isin(anchors(digests)[0], np.array(ats, np.int64)))
                        view = memoryview(digests)
                        start, stop = places(t)
                        for low in range(0, len(at), SENT):
                            some = at[low : low + SENT]
                            d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[16 * i : 16 * (i + WINDOW)]) for i in some.tolist()]), np.int64).reshape(-1, 2)
                            owner = pa.array(np.full(len(some), k, np.int32))
                            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array(some.astype(np.int32)), pa.array(start[some]), pa.array(stop[some + WINDOW - 1]), pa.array(d[:, 0]), pa.array(d[:, 1])], names=schema.names)
        words.clear()
        give_back()

    return mapped(plain.join(wanted, ["id", "v"]).select("id", "v", "text", "ats"), run, schema)


def _kinds(rows: DataFrame, on: list[str]) -> DataFrame:
    """Per kind of row its first place (first: id, v, start) and how many it has (n)."""
    return rows.groupBy(*on).agg(F.min(F.struct("id", "v", "start", "at")).alias("first"), F.count(F.lit(1)).alias("n"))


def _later(rows: DataFrame, kinds: DataFrame, on: list[str]) -> DataFrame:
    """(id, v, start, stop, kept_in) of the rows that are not the first of their kind."""
    firsts = kinds.where("n > 1").select(*on, F.col("first.id").alias("_id"), F.col("first.v").alias("_v"), F.col("first.start").alias("_start"), "n")
    after = F.struct("id", "v", "start") > F.struct(F.col("_id").alias("id"), F.col("_v").alias("v"), F.col("_start").alias("start"))
    return looked_up(rows, saved(firsts, "unit-firsts"), on, "n", most=DIGESTS).where(after).select("id", "v", "start", "stop", F.col("_id").alias("kept_in"))


def repeats(plain: DataFrame, line_words: int = LINE_WORDS) -> DataFrame:
    """(id, v, start, stop, kept_in) of every unit that is not the first of its kind. plain: texts()."""
    if line_words < 1:
        raise ValueError("line_words is at least 1")
    found = saved(_reading(plain, line_words), "units")
    blocks_, a = found.where(F.col("kind") != ANCHOR), found.where(F.col("kind") == ANCHOR)
    again = _later(blocks_, _kinds(blocks_, ["kind", "h1", "h2"]), ["kind", "h1", "h2"])
    twice = saved(a.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchor-repeats")
    met = saved(looked_up(a, twice, ["h1"], "n", most=DIGESTS), "anchors-met")
    kinds = saved(_kinds(met, ["h1", "h2"]), "contexts")
    several = saved(kinds.groupBy("h1").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "anchors-several")
    spots = looked_up(kinds.select("h1", "first"), several, ["h1"], "m").select("first.id", "first.v", "first.at")
    wanted = saved(spots.groupBy("id", "v").agg(F.collect_set("at").alias("ats")), "window-texts")
    w = saved(_windows(plain, small_side(wanted)), "windows")
    return again.unionByName(_later(met, kinds, ["h1", "h2"])).unionByName(_later(w, _kinds(w, ["h1", "h2"]), ["h1", "h2"]))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", line_words: int = LINE_WORDS) -> DataFrame:
    """The spans to remove: id, v (xxhash64 of the text), start, stop, and kept_in, the least id that was met with some of it
    before. They do not touch."""
    in_order = Window.partitionBy("id", "v").orderBy("start", "stop")
    before = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    found = repeats(texts(docs, key, text), line_words).distinct().withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
    numbered = found.withColumn("span", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy("id", "v", "span")
    return grouped.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("kept_in").alias("kept_in")).drop("span")


def removed(text: str, cuts: list[tuple[int, int]]) -> str:
    """text without the cuts, which do not overlap."""
    out, at = [], 0
    for start, stop in sorted(cuts):
        out.append(text[at:start])
        at = stop
    return "".join([*out, text[at:]])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", line_words: int = LINE_WORDS) -> DataFrame:
    """docs without its repeated units; all rows and columns stay."""
    id_, v, cuts = (column_name(docs, c) for c in ("_id", "_v", "_cuts"))
    per = spans(docs, key, text, line_words).groupBy(F.col("id").alias(id_), F.col("v").alias(v)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s"))
    per = saved(per.select(id_, v, F.flatten(F.transform("s", lambda x: F.array(x["start"], x["stop"]))).alias(cuts)), "unit-spans")
    joined = docs.join(small_side(per), (docs[key] == F.col(id_)) & (F.xxhash64(docs[text].cast("string")) == F.col(v)), "left").drop(id_, v)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                b = whole.slice(first, SLICE)
                new = [t if t is None or not c else removed(t, list(zip(c[::2], c[1::2], strict=True))) for t, c in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(new, b.schema.field(at).type), *b.columns[at + 1 : -1]], names=names)
        give_back()

    return mapped(joined, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "start", "stop")


#: Every window is compared as a text here, without anchors or digests.
SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ps FROM d),
p AS (SELECT doc_id, text, unnest(ps) AS w, generate_subscripts(ps, 1) AS k FROM s),
q AS (SELECT doc_id, text, w, k, (sum(length(w)) OVER (PARTITION BY doc_id, text ORDER BY k))::INT AS stop FROM p),
w AS (SELECT doc_id, text, lower(w) AS w, (stop - length(w))::INT AS start, stop, row_number() OVER (PARTITION BY doc_id, text ORDER BY k) AS i
      FROM q WHERE regexp_matches(w, '^[^\x20\x09-\x0D]')),
l AS (SELECT *, length(text[1:start]) - length(replace(text[1:start], chr(10), '')) AS line, len(regexp_extract_all(text[1:start], '\n[ \t\x0B\f\r]*\n\s*')) AS par FROM w),
u AS (SELECT 'l' || string_agg(w, ' ' ORDER BY i) AS t, doc_id, text, min(start) AS start, max(stop) AS stop FROM l GROUP BY doc_id, text, line HAVING count(*) >= {LINE_WORDS}
      UNION ALL SELECT 'p' || string_agg(w, ' ' ORDER BY i), doc_id, text, min(start), max(stop) FROM l GROUP BY doc_id, text, par
      UNION ALL SELECT * FROM (SELECT 'w' || string_agg(w, ' ') OVER r AS t, doc_id, text, min(start) OVER r AS start, max(stop) OVER r AS stop FROM w
                WINDOW r AS (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) QUALIFY count(*) OVER r = {WINDOW})),
f AS (SELECT doc_id, text, start, stop, row_number() OVER o AS n FROM u WINDOW o AS (PARTITION BY t ORDER BY doc_id, text, start)),
b AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, text ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f WHERE n > 1),
g AS (SELECT *, sum((before IS NULL OR before < start)::INT) OVER (PARTITION BY doc_id, text ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS span FROM b)
SELECT doc_id, min(start) AS start, max(stop) AS stop FROM g GROUP BY doc_id, text, span
"""
