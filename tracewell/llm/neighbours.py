"""Approximate nearest neighbours by largest inner product, in a forest of sorted hash strings.

Each of TREES trees gives a vector a hash string of PROJECTIONS * DIGITS bits: first the halves, then the quarters and so on
in which PROJECTIONS random projections of the vector lie. Short prefixes part what points elsewhere, long ones part near
copies, so no leaf stays large. A query descends each sorted tree to its longest matching prefix; then all trees ascend
together, one length at a time, until at least `wanted` entries, counted over the trees, share a prefix of that length with
it. Those entries are scored in double precision and the nearest are kept.

Inner product becomes nearness on a sphere: an entry x is (x / M, sqrt(1 - |x|^2 / M^2)), with M the largest norm, and a query
is (q / |q|, 0). Means and deviations of the projections come from all entries.

`wanted` is fitted: for SAMPLE queries at most (the least by a hash) the true neighbours among all entries are found, and the
least `wanted` is taken that finds TARGET of them. That is one pass over the entries. The worst case is to ascend to the
empty prefix, which is the exact search; random vectors without structure come close to it.

At scale: a tree is cut into buckets by a prefix that nearly all queries of the sample keep, and a large bucket into blocks. Queries meet a
block twice: for the counts of each length, and to be scored. Equal vectors are one entry with its K + 1 least ids, as no
later id can be among the K nearest of any query; a query vector is searched once, whatever the number of its rows.

Defined results: vectors that are null, zero, or hold a null or a non-finite component, and rows without an id, take no part.
A shorter vector counts as if zeros followed. Rows that share an id are one candidate, at its best score, and one query, with
the best of its vectors. Ties go to the smaller id. With fewer candidates than K, all are returned; an empty table, or one
without queries, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, mapped, saved, small_side

TREES, PROJECTIONS, DIGITS = 16, 21, 6
BITS = PROJECTIONS * DIGITS
K = 20
#: Queries whose true neighbours are found to fit the forest, and the share of these that it is to find.
SAMPLE, TARGET = 200, 0.95
#: Lengths of prefixes at which the trees stop on their way up.
LEVELS = [*range(25), *range(28, BITS + 1, 7)]
#: Bits of a bucket's prefix at most, and bytes of a block's vectors.
BUCKET_BITS, BLOCK_BYTES = 24, 16 << 20
#: Products held at once.
CELLS = 4_000_000
#: Scores this near, relative to the norms, are told apart by a sum of fixed order only.
NEAR = 1e-12


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    size = np.diff(np.asarray(column.offsets))
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out


class Forest:
    """Random projections of vectors of so many components, and what all entries say of them."""

    def __init__(self, dims: int, norm: float, seed: int = 11):
        self.dims, self.norm, self.seed = dims, norm, seed
        self.mean, self.deviation = np.zeros(TREES * PROJECTIONS), np.ones(TREES * PROJECTIONS)

    def projected(self, x: np.ndarray, query: bool) -> np.ndarray:
        w = np.random.default_rng(self.seed).standard_normal((self.dims + 1, TREES * PROJECTIONS))
        if query:
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            return x @ w[:-1]
        x = x / self.norm
        return x @ w[:-1] + np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0)) * w[-1]

    def keys(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """A row of TREES hash strings of 16 bytes per vector."""
        z = (self.projected(x, query) - self.mean) / self.deviation
        cell = np.floor((1 << DIGITS) / (1 + np.exp(-1.702 * np.clip(z, -30, 30)))).astype(np.int64)
        cell = np.minimum(cell, (1 << DIGITS) - 1).reshape(len(x), TREES, 1, PROJECTIONS)
        bits = (cell >> np.arange(DIGITS - 1, -1, -1)[:, None]) & 1  # the first digit of all projections comes first
        return np.packbits(bits.reshape(len(x), TREES, BITS).astype(np.uint8), axis=2).view("S16")[:, :, 0]


def bounds(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest string with the same so many first bits."""
    raw = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 16)
    mask = np.packbits(np.arange(128) < np.asarray(bits)[:, None], axis=1)
    return np.ascontiguousarray(raw & mask).view("S16")[:, 0], np.ascontiguousarray(raw | ~mask).view("S16")[:, 0]


def ranges(tree: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where, in a sorted array of strings, those lie that share so many first bits with each key."""
    low, high = bounds(keys, bits)
    return np.searchsorted(tree, low), np.searchsorted(tree, high, side="right")


def strings(column: pa.Array) -> np.ndarray:
    """A column of 16 bytes each as an array of strings."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, "S16")
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], "S16", len(column), int(start))


def nearest(entries: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int):
    """(row, entry, score) of each query's k nearest entries, ties to the smaller id; scores of a fixed order of summation."""
    found = []
    size = np.sqrt((entries * entries).sum(1)).max(initial=0)
    step = max(1, CELLS // max(1, len(entries)))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        s = part @ entries.T
        if len(entries) > k:
            least = np.partition(s, len(entries) - k, axis=1)[:, len(entries) - k]
            row, col = np.nonzero(s >= (least - NEAR * size * np.sqrt((part * part).sum(1)))[:, None])
        else:
            row, col = np.nonzero(np.ones_like(s, bool))
        exact = (part[row] * entries[col]).sum(1)
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        use = place < k
        found.append((row[use] + at, col[use], exact[use]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, norm) of the rows that take part."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind if kind in ('float', 'double') else 'double'}>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite)
    most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    rows = rows.withColumn("most", most).where("most > 0")
    norm = F.col("most") * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(x / F.col("most"), F.lit(2.0))))
    return rows.select("id", "v", F.least(norm, F.lit(1e308)).alias("norm"))


def fitted(entries: DataFrame, dims: int, norm: float) -> Forest:
    """The forest with the means and deviations of its projections over all entries: two numbers a projection."""
    forest = Forest(dims, norm)

    def run(batches):
        total = np.zeros((3, TREES * PROJECTIONS))
        for b in batches:
            z = forest.projected(matrix(b.column(0), dims), False)
            total += np.stack([np.full(z.shape[1], len(z)), z.sum(0), (z * z).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), *map(pa.array, total)], names=["k", "n", "s", "s2"])

    rows = mapped(entries.select("v"), run, "k long, n double, s double, s2 double").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")])
    n, s, s2 = np.array([r[1:] for r in sorted(rows.collect())]).T
    forest.mean = s / n
    forest.deviation = np.sqrt(np.maximum(s2 / n - forest.mean**2, 1e-18))
    return forest


def keyed(entries: DataFrame, forest: Forest, query: bool) -> DataFrame:
    """entries (rep, least, v) with keys: a hash string per tree."""

    def run(batches):
        for b in batches:
            raw = forest.keys(matrix(b.column(2), forest.dims), query)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), raw.size, [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
            offsets = pa.array(np.arange(0, raw.size + 1, TREES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, flat)], names=["rep", "least", "v", "keys"])

    element = entries.schema["v"].dataType.elementType.simpleString()
    return mapped(entries.select("rep", "least", "v"), run, f"rep long, least long, v array<{element}>, keys array<binary>")


def wanted_of(index: DataFrame, queries: DataFrame, forest: Forest, k: int) -> tuple[int, int]:
    """How many entries a query's trees are to share a prefix with, and the length of prefixes that cuts trees into buckets."""
    some = queries.orderBy(F.xxhash64("rep"), "rep").select("rep", "v").limit(SAMPLE).collect()
    own = np.array([r.rep for r in some])
    x = np.zeros((len(some), forest.dims))
    for i, r in enumerate(some):
        x[i, : len(r.v)] = r.v
    keys = forest.keys(x, True)
    levels = np.array(LEVELS)

    def run(batches):
        counts = np.zeros((len(x), len(levels)), np.int64)
        rep, score, lcp = np.full((len(x), 0), -1), np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            ids, e = np.asarray(b.column(0)), matrix(b.column(1), forest.dims)
            trees = strings(b.column(2).flatten()).reshape(-1, TREES)
            for t in range(TREES):
                low, high = ranges(np.sort(trees[:, t]), np.repeat(keys[:, t], len(levels)), np.tile(levels, len(x)))
                counts += (high - low).reshape(counts.shape)
            s = x @ e.T
            s[own[:, None] == ids] = -np.inf
            best = np.argsort(-s, 1, kind="stable")[:, :k]
            same = trees[best].view(np.uint8).reshape(*best.shape, TREES, 16) ^ np.ascontiguousarray(keys).view(np.uint8).reshape(len(x), 1, TREES, 16)
            bits = np.concatenate([np.unpackbits(same, axis=3), np.ones((*best.shape, TREES, 1), np.uint8)], 3)
            rep = np.concatenate([rep, ids[best]], 1)
            score = np.concatenate([score, np.take_along_axis(s, best, 1)], 1)
            lcp = np.concatenate([lcp, bits.argmax(3).max(2)], 1)
            order = np.argsort(-score, 1, kind="stable")[:, :k]
            rep, score, lcp = (np.take_along_axis(a, order, 1) for a in (rep, score, lcp))
        i, j = np.nonzero(score > -np.inf)
        ci, cj = np.nonzero(counts)
        none = np.full(len(ci), 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((i, ci), (rep[i, j], none), (score[i, j], none * 1.0), (lcp[i, j], none), (i * 0 - 1, cj), (i * 0, counts[ci, cj]))], names=["i", "rep", "score", "lcp", "level", "n"])

    seen = saved(mapped(index.select("rep", "v", "keys"), run, "i long, rep long, score double, lcp long, level long, n long"), "forest-sample")
    best = Window.partitionBy("i").orderBy(F.col("score").desc(), "rep")
    true = seen.where("level < 0").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("i", "lcp").collect()  # k a query of the sample
    counts = np.zeros((len(x), len(levels)), np.int64)
    for i, level, n in seen.where("level >= 0").groupBy("i", "level").agg(F.sum("n")).collect():  # one per query of the sample and length
        counts[i, level] = n
    if not true:
        return 1, 0
    i, lcp = np.array(true, np.int64).T
    wanted, most = float(k), int(counts[:, 0].max())
    while True:
        stop = levels[np.maximum((counts >= wanted).sum(1) - 1, 0)]
        if (lcp >= stop[i]).mean() >= TARGET or wanted > most:
            return int(np.ceil(wanted)), int(min(BUCKET_BITS, np.quantile(stop, 0.05)))
        wanted *= 1.2


def bucket_of(key: Column, bits: int) -> Column:
    first = F.conv(F.hex(F.substring(key, 1, 3)), 16, 10).cast("long")
    return F.shiftright(first, BUCKET_BITS - bits)


def by_tree(rows: DataFrame, bits: int, *carried: str) -> DataFrame:
    """A row per tree: tree, bucket and key."""
    out = rows.select(*carried, F.posexplode("keys").alias("tree", "key"))
    return out.withColumn("bucket", bucket_of(F.col("key"), bits))


PLACE = ["tree", "bucket", "block"]


def stops(entries: DataFrame, queries: DataFrame, buckets: DataFrame, bits: int, wanted: int) -> DataFrame:
    """(rep, level): the longest prefix at which the trees together hold the wanted entries."""
    levels = np.array([x for x in LEVELS if x >= bits])

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        tree = np.sort(strings(left["key"]))
        keys = strings(right["key"])
        low, high = ranges(tree, np.repeat(keys, len(levels)), np.tile(levels, len(keys)))
        flat = pa.array(high - low)
        return pa.table({"rep": right["rep"], "counts": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(levels), dtype=np.int32)), flat)})

    asked = by_tree(queries, bits, "rep")
    spread = asked.join(small_side(buckets.drop("n")), ["tree", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = entries.select(*PLACE, "key").groupBy(*PLACE).cogroup(spread.select(*PLACE, "rep", "key").groupBy(*PLACE)).applyInArrow(count, "rep long, counts array<long>")
    total = each.groupBy("rep").agg(*[F.sum(F.col("counts")[i]).alias(f"c{level}") for i, level in enumerate(levels.tolist())])
    reached = [F.when(F.col(f"c{level}") >= wanted, F.lit(level)) for level in levels.tolist()]
    level = F.greatest(*reached) if len(reached) > 1 else reached[0]
    out = saved(queries.select("rep").join(total, "rep", "left").select("rep", level.alias("level")), "forest-levels")
    if bits == 0:
        return out.fillna(0)
    # queries that ascend above the buckets: their counts are those of whole buckets
    above = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level")
    up = lambda d: d.withColumn("prefix", F.expr(f"shiftright(bucket, {bits} - level)"))
    whole = saved(up(buckets.select("tree", "bucket", "n", above)).groupBy("tree", "level", "prefix").agg(F.sum("n").alias("n")), "forest-prefixes")
    left = asked.join(small_side(out.where("level IS NULL").select("rep")), "rep", "left_semi")
    sums = up(left.select("rep", "tree", "bucket", above)).join(small_side(whole), ["tree", "level", "prefix"]).groupBy("rep", "level").agg(F.sum("n").alias("n"))
    coarse = sums.where(F.col("n") >= wanted).groupBy("rep").agg(F.max("level").alias("coarse"))
    return saved(out.join(coarse, "rep", "left").select("rep", F.coalesce("level", "coarse", F.lit(0)).alias("level")), "forest-levels")


def scored(entries: DataFrame, queries: DataFrame, buckets: DataFrame, bits: int, levels: DataFrame, forest: Forest, k: int) -> DataFrame:
    """(q, rep, least, score): the k nearest of each block among the entries that share a query's prefix."""
    schema = pa.schema([("q", pa.int64()), ("rep", pa.int64()), ("least", pa.int64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        key = strings(left["key"])
        order = np.argsort(key, kind="stable")
        e, least, rep, q = matrix(left["v"], forest.dims)[order], np.asarray(left["least"])[order], np.asarray(left["rep"])[order], np.asarray(right["q"])
        x = matrix(right["v"], forest.dims)
        low, high = ranges(key[order], strings(right["key"]), np.asarray(right["level"]))
        found = []
        for lo, hi in np.unique(np.stack([low, high], 1), axis=0).tolist():
            some = np.flatnonzero((low == lo) & (high == hi))
            row, col, value = nearest(e[lo:hi], least[lo:hi], x[some], k)
            found.append((q[some[row]], rep[lo + col], least[lo + col], value))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)] if found else [[]] * 4, schema=schema)

    asked = by_tree(queries.join(small_side(levels), "rep"), bits, "rep", "level", "v")
    width = F.expr(f"int(shiftleft(1, greatest({bits} - level, 0)))")
    first = F.col("bucket") - F.col("bucket") % F.col("width")
    asked = asked.withColumn("width", width).withColumn("bucket", F.explode(F.sequence(first, first + F.col("width") - 1)))
    asked = asked.join(small_side(buckets.drop("n")), ["tree", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select(*PLACE, F.col("rep").alias("q"), F.col("level").cast("long").alias("level"), "key", "v")
    return entries.groupBy(*PLACE).cogroup(asked.groupBy(*PLACE)).applyInArrow(score, "q long, rep long, least long, score double")


def first_of(rows: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The k best items of each group, by score and then item, with their rank. Only k of a group leave a task."""
    best = rows.groupBy(group, item).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("score").desc(), item))).where(F.col("rank") <= k)


def search(vectors: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that the condition on the column id selects."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = saved(usable(vectors, key, vector), "forest-rows")
    dims, norm = rows.agg(F.max(F.size("v")), F.max("norm")).first()
    if not dims:
        return none
    entries = rows.groupBy("v").agg(F.min("id").alias("least"))
    entries = saved(entries.select(F.monotonically_increasing_id().alias("rep"), "least", "v"), "forest-entries")
    members = saved(rows.select("id", "v").join(entries.select("rep", "v"), "v").select("rep", "id").distinct(), "forest-members")
    owners = saved(members.where(asked), "forest-queries")
    forest = fitted(entries, dims, norm)
    index = saved(keyed(entries, forest, False), "forest-index")
    queries = saved(keyed(entries.join(small_side(saved(owners.select("rep").distinct(), "forest-asked")), "rep", "left_semi"), forest, True), "forest-asked")
    if queries.isEmpty():
        return none
    wanted, bits = wanted_of(index, queries, forest, k)
    placed = by_tree(index, bits, "rep", "least", "v")
    most = max(1, BLOCK_BYTES // (8 * dims))
    buckets = by_tree(index, bits).groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("n"))
    buckets = saved(buckets.withColumn("blocks", F.ceil(F.col("n") / most).cast("int")), "forest-buckets")
    placed = looked_up(placed, buckets, ["tree", "bucket"], "n").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    levels = stops(placed, queries, buckets, bits, wanted)
    found = saved(scored(placed, queries, buckets, bits, levels, forest, k + 1), "forest-found")
    found = found.groupBy("q", "rep").agg(F.max("score").alias("score"), F.max("least").alias("least"))
    near = Window.partitionBy("q").orderBy(F.col("score").desc(), "least", "rep")
    found = saved(found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1).select("q", "rep", "score"), "forest-nearest")
    first = members.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k + 1)
    lists = first_of(found.join(first.select("rep", F.col("id").alias("vec_id")), "rep"), "q", "vec_id", k + 1)
    out = owners.select(F.col("id").alias("query_id"), F.col("rep").alias("q")).join(saved(lists.drop("rank"), "forest-lists"), "q").where("vec_id <> query_id")
    return first_of(out, "query_id", "vec_id", k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
