"""Token ids as files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file holds segments. A segment holds whole documents in ascending order of their key and stands alone: its code book
lists the ids it uses, the most frequent first (ties: the smaller id); each token is stored as its rank, in as few bytes
as that needs; two control bits per token, four tokens to a control byte, say how many. Decoding looks up the lengths of
four tokens by their control byte and gathers their bytes, all in numpy. Segments are rows of Parquet files, so that any
store that Spark writes to can hold them and a lost executor's part is written again.

Order: documents go to ranges of keys by quantiles of the key column, each range to the task of its number, and are sorted
there: the files follow each other in the order of the keys. No range bound depends on a text, so one document is encoded
once. There are so many ranges that one holds about RANGE_BYTES of text; null keys, and a key that fills several ranges, are
dealt over theirs by a hash of the ids.

Defined results: a null text has only the end id. A null key sorts first; keys are whole numbers, others are refused. Rows that repeat a key are all stored, by range and
then by their ids in order; equal rows stay together. An empty table gives no segment.
"""

from __future__ import annotations

import functools
import json
import os
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import NEWER, UNITS, byte_alphabet, default_vocabulary
from .chunks import Chunks
from .common import saved, text_map, whole_numbers

END_ID = 2
#: Tokens of a segment; one longer document is a segment of its own.
SEGMENT_TOKENS = 1_000_000
#: Ids below this are counted in a table.
TABLE = 1 << 22
#: Bytes of text that a range of keys holds on average; there are as many ranges as shuffle partitions at least.
RANGE_BYTES = 512 << 20
#: Characters of text whose new chunks are encoded together.
GROUP_CHARS = 4_000_000
#: Bytes of chunks that a task remembers between groups.
REMEMBERED = 100_000_000
_MASK = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
#: Control byte -> bytes of its four tokens.
_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Code book, control bytes and data bytes of some ids."""
    if len(ids) and ids.max() < TABLE:  # a table by id spares the sort
        every = np.bincount(ids)
        used = np.flatnonzero(every)
        by_rank = np.lexsort((used, -every[used]))
        rank_of = np.empty(len(every), np.uint32)
        rank_of[used[by_rank]] = np.arange(len(used), dtype=np.uint32)
        ranks = rank_of[ids]
    else:
        used, place, count = np.unique(ids, return_inverse=True, return_counts=True)
        by_rank = np.lexsort((used, -count))
        rank_of = np.empty(len(used), np.uint32)
        rank_of[by_rank] = np.arange(len(used), dtype=np.uint32)
        ranks = rank_of[place]
    size = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(size) // 4) * 4, np.uint8)
    padded[: len(size)] = size
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    raw = np.ascontiguousarray(ranks.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return used[by_rank].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), raw[np.arange(4) <= size[:, None]].tobytes()


def unpack(n: int, book: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The n ids that pack() stored, as unsigned 32-bit integers."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    ranks = raw[start]
    for k in range(1, int(size.max()) if n else 1):
        ranks |= raw[start + k] << np.uint32(8 * k)
    return np.frombuffer(book, "<u4")[ranks & _MASK[size - 1]]


@functools.cache
def library_encoder(path: str) -> Chunks:
    """Encoding by the tokenizers library, each distinct chunk once; ids as little-endian unsigned 32-bit integers. Chunks
    whose units Python's pattern surely finds go to the library's model unit by unit; all others through its whole path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    shown = {chr(b): c for b, c in byte_alphabet().items()}
    table, tokenize, find = str.maketrans(shown), t.model.tokenize, UNITS.findall
    with open(path, encoding="utf-8") as f:
        marks = [x["content"] for x in json.load(f)["added_tokens"]]

    def whole(text: str) -> bytes:
        return array("I", t.encode(text, add_special_tokens=False).ids).tobytes()

    plain = not any(m.strip().isalpha() for m in marks)  # letters alone are then no special token

    def new(chunks: list[str]) -> list[bytes]:
        units: dict[str, bytes] = {}

        def unit(u: str) -> bytes:
            ids = units.get(u)
            if ids is None:
                ids = units[u] = array("I", [x.id for x in tokenize(u.encode().decode("latin-1").translate(table))]).tobytes()
            return ids

        out = []
        for c in chunks:
            old = c.isascii() or not c or max(c) < NEWER
            if plain and old and c[1:].isalpha() and c[0] == " ":  # a space and letters are one unit
                out.append(unit(c))
            elif plain and old and c[-1:] in ".," and c[1:-1].isalpha() and c[0] == " ":
                out.append(unit(c[:-1]) + unit(c[-1]))
            elif not old or any(m in c for m in marks):
                out.append(whole(c))
            else:
                out.append(b"".join([unit(u) for u in find(c)]))
        return out

    return Chunks(new, whole, GROUP_CHARS, REMEMBERED)


def _segments(key: str):
    schema = StructType.fromDDL("range int, segment int, docs binary, key_nulls binary, counts binary, n_tokens long, book binary, control binary, data binary")

    def run(batches):
        held: list = []
        tokens = number = 0
        current = None

        def flush():
            ids = np.concatenate([np.frombuffer(i, "<u2" if w == 2 else "<u4") for _, i, w in held])
            keys = [k for k, _, _ in held]
            counts = np.array([len(i) // w for _, i, w in held], "<i8")
            row = (current, number, np.array([k or 0 for k in keys], "<i8").tobytes(), bytes(k is None for k in keys), counts.tobytes(), len(ids), *pack(ids))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=schema.names)

        for b in batches:
            for r, k, i, w in zip(*[b.column(c).to_pylist() for c in ("range", key, "ids", "width")], strict=True):
                n = len(i) // w
                if held and (r != current or tokens + n > SEGMENT_TOKENS):
                    yield flush()
                    number = number + 1 if r == current else 0
                    held, tokens = [], 0
                current = r
                held.append((k, i, w))
                tokens += n
        if held:
            yield flush()

    return run, schema


def write(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes every text and writes the segments to the shared folder. Returns the written table."""
    path = path or default_vocabulary()
    whole_numbers(docs, key)
    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    nulls, bounds = key_ranges(keyed)
    total = nulls + len(bounds) + 1
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encoder = library_encoder(path)

        def apply(texts):
            for i in encoder.encode([t or "" for t in texts]):
                ids = np.frombuffer(i + end, "<u4")
                wide = 4 if ids.max() > 0xFFFF else 2
                yield wide, ids.astype("<u2").tobytes() if wide == 2 else ids.tobytes()

        apply.close = encoder.forget
        return apply

    coded = text_map(keyed, ["key"], "text", "width int, ids binary", make, rows=2048)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series, ties: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(bounds, keys.to_numpy(np.int64), side=s) for s in ("left", "right"))
        return pd.Series((nulls + low + ties.to_numpy(np.int64) % np.maximum(high - low, 1)).astype(np.int32))

    tie = F.xxhash64("ids")
    known = range_of(F.coalesce("key", F.lit(0)), tie)
    coded = coded.withColumn("range", F.when(F.col("key").isNull(), F.pmod(tie, F.lit(max(nulls, 1))).cast("int")).otherwise(known))
    run, schema = _segments("key")
    return saved(coded.repartitionById(total, "range").sortWithinPartitions("range", "key", "ids").mapInArrow(run, schema), "token-files")


def key_ranges(keyed: DataFrame) -> tuple[int, np.ndarray]:
    """How many ranges null keys get, and the greatest keys of all other ranges but the last. A key that fills several
    ranges is the bound of each."""
    rows, known, size = keyed.agg(F.count(F.lit(1)), F.count("key"), F.sum(F.octet_length("text"))).first()
    ranges = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))
    nulls = -(-ranges * (rows - known) // max(rows, 1))
    ranges = max(ranges - nulls, 1)
    if not known or ranges == 1:
        return nulls, np.zeros(0, np.int64)
    found = keyed.approxQuantile("key", [k / ranges for k in range(1, ranges)], 0.1 / ranges)
    return nulls, np.array(sorted(max(min(int(x), 2**63 - 1), -(2**63)) for x in found), np.int64)


def read(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: range, segment, place (tokens before it in its segment), n_tokens, and ids."""
    schema = StructType([*StructType.fromDDL("range int, segment int").fields, StructField(key, LongType()), *StructType.fromDDL("place long, n_tokens long, ids binary").fields])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                raw = unpack(r["n_tokens"], r["book"], r["control"], r["data"]).astype("<u4").tobytes()
                counts = np.frombuffer(r["counts"], "<i8")
                place = np.cumsum(counts) - counts
                keys = [None if no else k for k, no in zip(np.frombuffer(r["docs"], "<i8").tolist(), r["key_nulls"], strict=True)]
                ids = [raw[4 * a : 4 * (a + n)] for a, n in zip(place.tolist(), counts.tolist(), strict=True)]
                n = len(keys)
                cols = [pa.array([r["range"]] * n, pa.int32()), pa.array([r["segment"]] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(place, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return files.mapInArrow(run, schema)


def starts(files: DataFrame) -> DataFrame:
    """Per segment, the tokens of all segments before it. Only totals are ordered: of the ranges, then in each range."""
    totals = files.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("range", (F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("range_start"))
    inside = Window.partitionBy("range").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    own = files.select("range", "segment", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("segment_start"))
    return own.join(before, "range").select("range", "segment", (F.col("range_start") + F.col("segment_start")).alias("segment_start"))


def index(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: its key, start, n_tokens and the CRC of its ids."""
    docs = read(files, key).select("range", "segment", key, "place", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return docs.join(starts(files), ["range", "segment"]).select(key, (F.col("segment_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    return index(write(spark.read.parquet(f"{sf_dir}/documents.parquet")))


__all__ = ["index", "pack", "read", "starts", "unpack", "write"]
