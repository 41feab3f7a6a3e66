"""What the operators share: the shared working folder and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegralType, StringType, StructType

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
#: A word, as a regular expression that Java, RE2 and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes, as estimated by bytes_of, that may be broadcast; beyond, the join is shuffled.
BROADCAST_BYTES = 64 << 20
#: A key is hot beyond so many rows, and beyond this fraction of all rows: there are at most HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 10_000, 100_000
#: Documents that a Python function holds as objects at once.
SLICE = 512
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a
    folder of its own; a cluster without the setting is an error, since a machine-local folder would lose data."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tracewell-shared")
    return base.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends there and it survives executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a written table of numbers and arrays of numbers, to be broadcast if it takes at most so many bytes; else as it
    is, to be shuffled."""
    return F.broadcast(df) if bytes_of(df) <= most else df


def bytes_of(df: DataFrame) -> int:
    """What a written table of numbers, arrays of them, and short texts takes when it is broadcast, estimated from counts."""
    lists = [F.greatest(F.size(f.name), F.lit(0)) * 16 for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, StringType)]
    rows, *items = df.agg(F.count(F.lit(1)), *[F.sum(x) for x in lists + texts]).first()
    return rows * (100 + 12 * len(df.columns)) + sum(x or 0 for x in items)


def looked_up(left: DataFrame, right: DataFrame, on: list[str], count: str, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """left joined with right, which has a row per key and in the column count (dropped) the key's rows in left. A right of at
    most so many bytes is broadcast. Else keys with many rows in left are broadcast apart, at most 1 / HOT_SHARE of them, so that no task gets
    all rows of one; the others are shuffled."""
    if bytes_of(right) <= most:
        return left.join(F.broadcast(right.drop(count)), on, how)
    least = max(HOT_ROWS, (right.agg(F.sum(count)).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(count) > least).drop(count))
    rest = right.where(F.col(count) <= least).drop(count)
    others = left.join(hot.select(*on), on, "left_anti")
    return left.join(hot, on).unionByName(others.join(rest, on, how))


def mapped(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of at most BATCH_BYTES: the default of 10,000 rows is too wide for texts. The
    session keeps that setting, as it is read when the plan runs."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) != str(BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def text_map(df: DataFrame, keys: list[str], text: str, extra: str, fn: Callable[[], Callable[[list], Iterable[tuple]]], rows: int = SLICE) -> DataFrame:
    """Applies a function to lists of at most so many texts in every partition: fn() makes it once per task, it returns
    or yields one tuple of the extra columns (a DDL string) per text. keys are carried. Null texts arrive as None. What it
    remembers goes with the task: a function with the attribute close has it called, since Python workers are reused."""
    added = StructType.fromDDL(extra)
    schema = StructType([df.schema[k] for k in keys] + added.fields)
    if len({n.lower() for n in schema.names}) < len(schema.names):
        raise ValueError(f"carried columns must differ from each other and from {', '.join(added.names)}")
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = fn()
        batch = part = some = made = cols = filled = None
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    made = iter(apply(part.column(len(keys)).to_pylist()))
                    for k in range(0, part.num_rows, SLICE):
                        some = part.slice(k, SLICE)
                        cols = zip(*itertools.islice(made, some.num_rows), strict=True)
                        filled = [pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)]
                        yield pa.RecordBatch.from_arrays([*some.columns[: len(keys)], *filled], names=[*keys, *arrow.names])
        finally:
            getattr(apply, "close", lambda: None)()
            del apply
            batch = part = some = made = cols = filled = None  # what the last batch holds
            give_back()

    return mapped(df.select(*[df[k] for k in keys], df[text].cast("string")), run, schema)


def give_back() -> None:
    """Returns memory that a finished task no longer uses to the system: Python workers outlive their tasks, and what
    their allocators keep would count against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def whole_numbers(df: DataFrame, key: str) -> None:
    """Refuses a key column that is not of a whole-number type: ids are compared and ranked as longs."""
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must hold whole numbers, not {df.schema[key].dataType.simpleString()}")


def column_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores until it clashes with no column of df (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
