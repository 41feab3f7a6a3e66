"""Line dedup by a deletion-neighbourhood join.

A line is normalised (lower case, single spaces) and read as words, which only [\x20\x09-\x0D] separates: any other blank is
part of a word. Two lines are near if at most one word is inserted,
deleted or replaced (edit distance 1 over words). A line goes if an earlier line, by id and place, equals it or is near
it; so of a set of copies the earliest stays. Only lines of at least near_words words (NEAR_WORDS, unless the caller says
otherwise; 1: all lines) can be near without being equal.

1. Lines are hashed; equal ones are grouped globally.
2. A line can only be near another if it shares its first or its last half with it. Lines whose half-hashes no other
   line has need no neighbourhood.
3. The others emit the hash of every variant within the bound: the line, and the line without one word, with the place
   of that word. Equal variants meet: a line without words deleted meets all that become it; two lines that lose a word
   at one place are one replacement apart. Each line is offered the earliest line of each meeting.
4. The edit distance of each offer is verified on the words; the earliest that holds is the reason to drop the line.

A line's rank is one number: its text's id, 31 bits of the text's hash, and its place.

Defined results: lines without a word stay and are compared with nothing; null or empty texts have no lines. Rows with a
null id are not compared; ids are whole numbers, others are refused. Rows that repeat an id and its text keep or lose a line alike; texts that share an id are ranked by
their hashes. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import HOT_ROWS, SEPARATORS, SLICE, column_name, give_back, looked_up, mapped, saved, small_side, whole_numbers

NEAR_WORDS = 8
LINES = "line_no int, start int, stop int, d1 long, d2 long, keys array<long>"
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def words_of(line: str) -> list[bytes]:
    return line.lower().encode("utf-8", "surrogatepass").split()  # bytes split at SEPARATORS only


def split_lines(text: str | None) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for line in (text or "").split("\n"):
        out.append((at, at + len(line), line))
        at += len(line) + 1
    return out


def digest(words: list[bytes]) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (d >> 64) - 2**63, (d & 2**64 - 1) - 2**63


def half_keys(words: list[bytes], near_words: int = NEAR_WORDS) -> list[int]:
    """Hashes of both halves, as cut for the line's own length and for a partner with one word less."""
    n = len(words)
    out = []
    for m in {n, max(n - 1, near_words)} if n >= near_words else ():
        half = m // 2
        for side, part in ((0, words[:half]), (1, words[n - (m - half) :])):
            out.append(xxhash.xxh3_64_intdigest(b" ".join(part), seed=2 * m + side) - 2**63)
    return out


def variants(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the line and of the line without each word; and the place of that word (-1: none)."""
    n = len(words)
    power = np.empty(n + 1, np.uint64)
    power[0] = 1
    power[1:] = np.cumprod(np.full(n, _BASE, np.uint64))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n) * power[:-1]
    before = np.concatenate([[np.uint64(0)], np.cumsum(h)])
    whole = before[n]
    without = before[:-1] + (whole - before[1:]) * np.uint64(_BACK)
    v = np.concatenate([[whole], without])
    sizes = np.concatenate([[n], np.full(n, n - 1)]).astype(np.uint64)
    v = (v ^ (v >> np.uint64(32))) * np.uint64(_BASE) + sizes
    return v.view(np.int64), np.arange(-1, n, dtype=np.int32)


def within_one(a: list, b: list) -> int | None:
    """0 or 1, the edit distance over words; None if it is more."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return None
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    if k == len(b):
        return 0
    return 1 if a[k + (len(a) == len(b)) :] == b[k + 1 :] else None


def lines(plain: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """A row for each line with a word. plain: ranked()."""
    schema = StructType([*plain.schema.fields[:2], *StructType.fromDDL(LINES).fields])
    types = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.list_(pa.int64())]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                owner, rows = [], []
                for k, t in enumerate(part.column(2).to_pylist()):
                    for number, (start, stop, line) in enumerate(split_lines(t)):
                        if words := words_of(line):
                            rows.append((number, start, stop, *digest(words), half_keys(words, near_words)))
                            owner.append(k)
                cols = list(zip(*rows, strict=True)) or [()] * len(types)
                at_ = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at_), part.column(1).take(at_), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=schema.names)
        give_back()

    return mapped(plain, run, schema)


def version(text: Column) -> Column:
    """31 bits of a text's hash, which tell texts of one id apart."""
    return F.xxhash64(text.cast("string")).bitwiseAND(F.lit(2**31 - 1))


def ranked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, v and text of the rows that are compared."""
    whole_numbers(docs, key)
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), version(F.col(text)).alias("v"), F.col(text).cast("string").alias("text"))


def _rank(doc: str = "doc", v: str = "v", line: str = "line_no") -> Column:
    """A line's rank, as one number that min() aggregates by hash."""
    low = F.shiftleft(F.col(v), 31) + F.col(line)
    return (F.col(doc).cast("decimal(20,0)") * F.lit(2**62).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def _place(rank: str) -> tuple[Column, Column, Column]:
    """doc, v and line_no of a rank."""
    whole = F.lit(2**62).cast("decimal(19,0)")
    low = F.pmod(F.col(rank), whole)
    doc = ((F.col(rank) - low) / whole).cast("long")
    return doc, F.shiftright(low.cast("long"), 31), (low.cast("long") % 2**31).cast("int")


def _texts(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, v, line_no and words (joined) of the wanted lines (doc, v, line_no)."""
    per = saved(wanted.groupBy("doc", "v").agg(F.array_sort(F.collect_set("line_no")).alias("numbers")), "line-wanted")
    schema = StructType.fromDDL("doc long, v long, line_no int, words string")

    def run(batches):
        for b in batches:
            out = []
            for d, v, t, numbers in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
                all_lines = split_lines(t)
                out += [(d, v, k, b" ".join(words_of(all_lines[k][2])).decode("utf-8", "surrogatepass")) for k in numbers]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=schema.names)

    return mapped(plain.join(small_side(per), ["doc", "v"]).select("doc", "v", "text", "numbers"), run, schema)


def _emit(batches):
    names = ["h", "place", "doc", "v", "line_no"]
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            made = [variants(w.encode("utf-8", "surrogatepass").split(b" ")) for w in part.column(3).to_pylist()]
            size = [len(v) for v, _ in made]
            owner = pa.array(np.repeat(np.arange(len(made), dtype=np.int32), size))
            cols = [pa.array(np.concatenate([v for v, _ in made])), pa.array(np.concatenate([p for _, p in made]))]
            yield pa.RecordBatch.from_arrays([*cols, *[part.column(c).take(owner) for c in range(3)]], names=names)


def near(plain: DataFrame, groups: DataFrame, halves: DataFrame) -> DataFrame:
    """(d1, d2, near): distinct lines with the rank of the earliest line before them that is near. groups: the distinct lines and
    their ranks (least); halves: (half, d1, d2)."""
    met = halves.groupBy("half").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("half", "n")
    some = saved(looked_up(halves, saved(met, "line-halves"), ["half"], "n").select("d1", "d2").distinct(), "line-near-halves")
    doc, v, no = _place("least")
    some = saved(groups.join(small_side(some), ["d1", "d2"], "left_semi").select("d1", "d2", doc.alias("doc"), v.alias("v"), no.alias("line_no"), "least"), "line-candidates")
    known = saved(_texts(plain, some).dropDuplicates(["doc", "v", "line_no"]), "line-words")
    made = saved(known.mapInArrow(_emit, "h long, place int, doc long, v long, line_no int"), "line-variants")
    by_place = saved(made.groupBy("h", "place").agg(F.min(_rank()).alias("least"), F.count(F.lit(1)).alias("rows")), "line-places")
    own, cut = F.min(F.when(F.col("place") < 0, F.col("least"))), F.min(F.when(F.col("place") >= 0, F.col("least")))
    by_hash = by_place.groupBy("h").agg(own.alias("own"), cut.alias("cut"), F.sum("rows").alias("all"), F.count(F.lit(1)).alias("places")).where("all > 1").drop("all")
    offers = looked_up(by_place, saved(by_hash, "line-meetings"), ["h"], "places")
    offers = offers.select("h", "place", "rows", F.when(F.col("place") < 0, F.col("cut")).otherwise(F.least("own", "least")).alias("offer")).where(F.col("offer").isNotNull())
    pairs = looked_up(made, saved(offers, "line-offers"), ["h", "place"], "rows").where(F.col("offer") < _rank())
    pairs = pairs.select("doc", "v", "line_no", "offer").distinct().join(known, ["doc", "v", "line_no"])
    taken = saved(pairs.groupBy("offer").agg(F.count(F.lit(1)).alias("n")), "line-offered")
    other = saved(known.withColumn("offer", _rank()).join(taken, "offer").select("offer", F.col("words").alias("other"), "n"), "line-others")
    held = pairs.join(other.drop("n"), "offer") if not other.where(F.col("n") > HOT_ROWS).take(1) else _spread(pairs, other)

    @F.pandas_udf("int")
    def edits(a, b):
        import pandas as pd

        return pd.Series([within_one(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype="Int32")

    holds = held.where(edits("words", "other").isNotNull())
    best = holds.groupBy("doc", "v", "line_no").agg(F.min("offer").alias("near"))
    return some.join(best, ["doc", "v", "line_no"]).select("d1", "d2", "near")


def _spread(pairs: DataFrame, other: DataFrame) -> DataFrame:
    """pairs joined with other on offer, where an offer of n pairs is copied to n / HOT_ROWS shares of them."""
    shares = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    copies = other.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("n")
    dealt = pairs.join(small_side(saved(other.where(F.col("n") > HOT_ROWS).select("offer", shares.alias("shares")), "line-shares")), "offer", "left")
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("doc", "v", "line_no"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    return dealt.join(copies, ["offer", "share"]).drop("share")


def repeats_of(plain: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc, v, line_no, start, stop, and kept: the rank of the earliest line that a removed line repeats; edits."""
    if near_words < 1:
        raise ValueError("near_words is at least 1")
    found = saved(lines(plain, near_words), "lines")
    groups = saved(found.groupBy("d1", "d2").agg(F.min(_rank()).alias("least"), F.count(F.lit(1)).alias("rows")), "line-groups")
    close = saved(near(plain, groups, found.select(F.explode("keys").alias("half"), "d1", "d2")), "line-near")
    many = groups.join(small_side(close), ["d1", "d2"], "left").where("rows > 1 OR near IS NOT NULL")
    out = looked_up(found.drop("keys"), saved(many, "line-many"), ["d1", "d2"], "rows")
    out = out.where(F.col("near").isNotNull() | (_rank() > F.col("least")))
    return out.select("doc", "v", "line_no", "start", "stop", F.coalesce("near", "least").alias("kept"), F.when(F.col("near").isNull(), 0).otherwise(1).alias("edits"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """The lines to remove: key, line_no, start, stop, the earliest line that each repeats (kept_id, kept_line), and edits:
    0 if it equals that line, else 1."""
    doc, _, no = _place("kept")
    return repeats_of(ranked(docs, key, text), near_words).select(F.col("doc").alias(key), "line_no", "start", "stop", doc.alias("kept_id"), no.alias("kept_line"), "edits")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", near_words: int = NEAR_WORDS) -> DataFrame:
    """docs without its repeated lines, with its columns (length, where it is a column, counts anew). A row whose every
    line with a word was a repeat goes; rows that had no such line stay."""
    id_, v, cut = (column_name(docs, c) for c in ("_id", "_v", "_gone"))
    gone = repeats_of(ranked(docs, key, text), near_words).groupBy(F.col("doc").alias(id_), F.col("v").alias(v)).agg(F.collect_set("line_no").alias(cut))
    same = (docs[key].cast("long") == F.col(id_)) & (version(docs[text]) == F.col(v))
    joined = docs.join(small_side(saved(gone, "line-gone")), same, "left").drop(id_, v)
    names, at = docs.columns, docs.columns.index(text)
    size = names.index(length) if length in names else None

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                b = whole.slice(first, SLICE)
                texts, drops = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                keep, sizes = [], (b.column(size).to_pylist() if size is not None else None)
                for k, (t, d) in enumerate(zip(texts, drops, strict=True)):
                    if d and t is not None:
                        d = set(d)
                        texts[k] = "\n".join(x for n, (_, _, x) in enumerate(split_lines(t)) if n not in d)
                        if sizes is not None:
                            sizes[k] = len(texts[k])
                    keep.append(not d or bool(texts[k].strip(SEPARATORS)))
                cols = list(b.columns[:-1])
                cols[at] = pa.array(texts, b.schema.field(at).type)
                if sizes is not None:
                    cols[size] = pa.array(sizes, b.column(size).type)
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))
        give_back()

    return mapped(joined, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Variants are joined as texts here, all of them, not by hash.
SQL = rf"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
a AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM t),
b AS (SELECT doc_id, line_no, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1)::INT AS start,
             regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS ws FROM a),
c AS (SELECT doc_id, line_no::INT AS line_no, start, (start + length(line))::INT AS stop, ws, array_to_string(ws, ' ') AS t FROM b WHERE len(ws) > 0),
d AS (SELECT t, any_value(ws) AS ws, min((doc_id, line_no)) AS f FROM c GROUP BY 1),
v AS (SELECT t, f, len(ws) AS n, i - 1 AS place, CASE i WHEN 0 THEN t ELSE array_to_string(ws[1:i - 1] || ws[i + 1:], ' ') END AS cut
      FROM (SELECT *, unnest(range(0, len(ws) + 1)) AS i FROM d WHERE len(ws) >= {NEAR_WORDS})),
p AS (SELECT y.t, x.f FROM v x JOIN v y ON x.cut = y.cut AND x.place = y.place AND x.place >= 0 AND x.f < y.f
      UNION ALL SELECT y.t, x.f FROM v x JOIN v y ON x.cut = y.cut AND (x.place < 0) <> (y.place < 0) AND x.f < y.f),
m AS (SELECT t, min(f) AS near FROM p GROUP BY 1)
SELECT doc_id, line_no, start, stop, coalesce(near, f)[1] AS kept_id, coalesce(near, f)[2] AS kept_line, (near IS NOT NULL)::INT AS edits
FROM c JOIN d USING (t) LEFT JOIN m USING (t) WHERE near IS NOT NULL OR (doc_id, line_no) <> f
"""
