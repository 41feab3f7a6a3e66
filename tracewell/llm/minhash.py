"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its SHINGLE-word shingles. Its signature has CHUNKS chunks of CHUNK components, each the least
of a seeded hash over the set. Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 components agree, by
pigeonhole, in all but ERRORS components of some chunk: so every chunk is indexed once per place of the allowed errors,
and all pairs under that distance meet under a key. At the similarity 0.8 a pair also beyond it is missed once in about
100,000 (0.263 ** 9), since each chunk alone finds it with probability 0.74.

1. Equal sets form classes; the least id stands for a class.
2. Documents that meet under a key and whose 4-bit components do not rule the pair out are joined into clusters. Within
   a key only a spanning forest is kept, never all pairs; keys with more than FEW documents join all of them.
3. Each cluster's full sets are compared, which confirms every link. A large cluster is cut into blocks, and each block is
   compared with itself and with some PIVOTS documents. Those that are then linked into the cluster's largest part need no
   comparison among themselves; only the rest is compared with every block.
4. Confirmed links give the components.

Defined results: a null text, or one without words, has the empty set and links with nothing. A text with fewer words
than a shingle is one shingle. A null id links with nothing; ids are whole numbers, others are
refused. Rows that share an id are one node: it is linked with all that one
of its texts is linked with, and so its rows are kept or not together. An empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_name, looked_up, saved, small_side, text_map, whole_numbers

CHUNKS, CHUNK, ERRORS = 9, 5, 1
K = CHUNKS * CHUNK
PERCENT = 80
#: Equal 4-bit components below which a pair is ruled out: at similarity 0.8 some 37 of 45 are expected, with deviation 2.6.
EQUAL = 24
#: Documents under a key up to which their pairs are looked at one by one.
FEW = 200
#: Documents, and bytes of their sets, of a block of a cluster.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Documents of a large cluster, on average, with which every block of it is compared first.
PIVOTS = 16
#: Words whose hashes a task remembers.
REMEMBERED = 150_000
_R = np.random.default_rng(20)
_A = _R.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 2**63, K, dtype=np.uint64)
_P = _R.integers(1, 2**63, CHUNK + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WILD = list(itertools.combinations(range(CHUNK), CHUNK - ERRORS))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(h))
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = _mix(out) + h[i : len(h) - k + 1 + i]
        return np.unique(_mix(out + np.uint64(k)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(K, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[k : k + 4096, None] * _A + _B).min(0))
    return _mix(out)


def keys_of(sig: np.ndarray) -> np.ndarray:
    """The index keys of a signature: each chunk without each choice of ERRORS components."""
    c = sig.reshape(CHUNKS, CHUNK)
    out = np.empty((CHUNKS, len(_WILD)), np.uint64)
    for w, kept in enumerate(_WILD):
        h = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(len(_WILD)) + np.uint64(w + 1)
        for k in kept:
            h = _mix(h * _P[0] + c[:, k])
        out[:, w] = h
    return out.ravel().view(np.int64)


def sketch(sig: np.ndarray) -> list[int]:
    """The low 4 bits of every component, 16 to a number."""
    n = np.zeros(48, np.uint64)
    n[:K] = sig & np.uint64(15)
    return (n.reshape(3, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64).tolist()


def equal_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many 4-bit components two sketches (rows of 3 numbers) share."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    x = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & np.uint64(0x1111111111111111)
    return K - np.bitwise_count(x).sum(1, dtype=np.int64)


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, n_shingles, a 128-bit digest of the set (d1, d2), sketch numbers and index keys."""

    def make():
        shingle = Shingler(size)

        def one(t):
            s = shingle(t)
            if not len(s):
                return 0, 0, 0, None, None
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            sig = signature(s)
            return len(s), (d >> 64) - 2**63, (d & 2**64 - 1) - 2**63, sketch(sig), keys_of(sig)

        return lambda texts: (one(t) for t in texts)

    return text_map(docs, [key], text, "n_shingles long, d1 long, d2 long, sketch array<long>, keys array<long>", make)


def _close(n: np.ndarray, sk: np.ndarray, key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows under one key that size and sketch do not rule out. key is sorted."""
    out, at, lag = [], np.arange(len(key)), 0
    while True:
        lag += 1
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            return out
        j = at + lag
        ok = 100 * np.minimum(n[at], n[j]) >= PERCENT * np.maximum(n[at], n[j])
        i, j = at[ok], j[ok]
        ok = equal_parts(sk[i], sk[j]) >= EQUAL
        out.append((i[ok], j[ok]))


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes and links i-j, the least node of each node's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]
    return label


def _forests(batches):
    """Sorted rows (key, id, n, s1, s2, s3) -> edges (a, b) that join the close documents under each key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            t = np.stack([np.asarray(b.column(c)) for c in range(6)], 1)
            held = t if held is None else np.concatenate([held, t])
        if held is None or not len(held):
            continue
        cut = len(held) if b is None else int(np.searchsorted(held[:, 0], held[-1, 0]))
        now, held = held[:cut], held[cut:]
        if not len(now):
            continue
        pairs = _close(now[:, 2], np.ascontiguousarray(now[:, 3:]), now[:, 0])
        i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        label = least_labels(len(now), i, j)
        x = np.flatnonzero(label != np.arange(len(now)))
        e = np.unique(np.stack([now[label[x], 1], now[x, 1]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], schema=schema)


def candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) with a < b whose components hold every pair that may be linked. reps: id, n, sketch, keys."""
    rows = reps.select(F.explode("keys").alias("key"), "id")
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("least")).where("docs > 1")
    met = saved(looked_up(rows, saved(met.withColumn("n", F.col("docs")), "near-keys"), ["key"], "n"), "near-met")
    few = met.where(F.col("docs") <= FEW).join(reps.select("id", "n", *[F.col("sketch")[k].alias(f"s{k}") for k in range(3)]), "id")
    few = few.select("key", "id", "n", "s0", "s1", "s2").repartition("key").sortWithinPartitions("key", "id")
    edges = few.mapInArrow(_forests, "a long, b long")
    many = met.where((F.col("docs") > FEW) & (F.col("id") != F.col("least"))).select(F.col("least").alias("a"), F.col("id").alias("b"))
    return edges.unionByName(many).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, label): every node of the edges (a, b) and the least id of its component. Each round hooks every label that has
    a link to a lesser one to the least such, follows labels once more, and contracts the edges; a round at least halves
    the labels that still have edges outside."""
    e = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)
    labels = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("label"))
    while True:
        hook = saved(e.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")), name)
        up = hook.select(F.col("from").alias("to"), F.col("to").alias("top"))
        hook = saved(hook.join(up, "to", "left").select("from", F.coalesce("top", "to").alias("to")), name)
        labels = saved(labels.join(hook, labels["label"] == hook["from"], "left").select("id", F.coalesce("to", "label").alias("label")), name)
        h1, h2 = (hook.select(F.col("from").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b"))
        e = e.join(h1, "a", "left").join(h2, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
        e = saved(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
        if e.isEmpty():
            return labels


def _confirm(batches):
    """Sorted rows (cluster, i, j, id, set) -> confirmed links (a, b), a star on the least id of each local component."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    group, held = None, []

    def flush():
        ids = np.array([x for x, _ in held], np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        sets = [np.frombuffer(held[k][1], np.uint64) for k in order.tolist()]
        size = np.array([len(s) for s in sets], np.int64)
        if len(ids) < 2:
            return None
        owner = np.repeat(np.arange(len(ids)), size)
        values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        column = np.cumsum(shared) - 1
        use = shared[place]
        owner, place = owner[use], column[place[use]]
        both = np.zeros((len(ids), len(ids)), np.float32)
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        for lo in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(place, [lo, lo + 4096])
            m = np.zeros((len(ids), 4096), np.float32)
            m[owner[a:b], place[a:b] - lo] = 1
            both += m @ m.T
        both = both.astype(np.int64)  # counts below 2**24 are exact in float32
        linked = 100 * both >= PERCENT * (size[:, None] + size - both)
        i, j = np.nonzero(np.triu(linked, 1))
        label = least_labels(len(ids), i, j)
        x = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[label[x]]), pa.array(ids[x])], schema=schema)

    for b in batches:
        for c, i, j, x, s in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
            if (c, i, j) != group:
                if held and (out := flush()) is not None:
                    yield out
                group, held = (c, i, j), []
            held.append((x, s))
    if held and (out := flush()) is not None:
        yield out


def sets(docs: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """keys and shingles: the sorted distinct 64-bit hashes of a text's shingles, as bytes."""

    def make():
        shingle = Shingler(size)
        return lambda texts: ((shingle(t).tobytes(),) for t in texts)

    return text_map(docs, keys, text, "shingles binary", make)


def compared(rows: DataFrame) -> DataFrame:
    """Links (a, b) inside each group (label, i, j) of documents (id, shingles)."""
    rows = rows.select("label", "i", "j", "id", "shingles")
    return rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "id").mapInArrow(_confirm, "a long, b long")


def confirmed(docs: DataFrame, clusters: DataFrame, text: str, size: int) -> DataFrame:
    """Links (a, b) between documents (id) of a cluster (id, label) whose full sets are at least PERCENT alike; enough of
    them to give the components of all."""
    wanted = docs.where(F.col("id").isNotNull()).join(small_side(clusters), "id")
    full = saved(sets(wanted, ["id", "label"], text, size).dropDuplicates(["id", "shingles"]), "near-sets")
    sized = full.groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("shingles")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sized = saved(sized.select("label", "docs", blocks.alias("blocks"), F.col("docs").alias("n")), "near-cluster-sizes")
    placed = looked_up(full, sized, ["label"], "n").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = placed.select("label", F.lit(0).alias("i"), F.col("block").alias("j"), "id", "shingles")
    if sized.where("blocks > 1").isEmpty():
        return compared(own)
    pivots = placed.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("id", F.lit("pivot")), F.ceil(F.col("docs") / PIVOTS)) == 0))
    pivots = pivots.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("j <> block").withColumn("i", F.lit(0))
    links = saved(compared(own.unionByName(pivots.select(*own.columns))), "near-links")
    parts = components(links, "near-parts").select("id", F.col("label").alias("part"))
    large = placed.where("blocks > 1").select("label", "id", "docs").join(parts, "id", "left").select("label", "id", "docs", F.coalesce("part", "id").alias("part"))
    core = large.groupBy("label", "part").agg(F.count(F.lit(1)).alias("c"), F.max("docs").alias("docs")).groupBy("label").agg(F.max(F.struct("c", "part")).alias("core"), F.max("docs").alias("docs"))
    core = saved(core.select("label", F.col("core.part").alias("core"), (F.col("docs") - F.col("core.c")).alias("left"), "docs").where("left > 0"), "near-cores")
    if core.isEmpty():
        return links
    marked = looked_up(large.drop("docs"), core, ["label"], "docs")
    marked = saved(marked.select("id", "label", "left", (F.col("part") == F.col("core")).alias("inside")).distinct(), "near-left")
    dealt = placed.join(small_side(marked), ["id", "label"]).withColumn("outer", F.ceil(F.col("left") * F.col("blocks") / F.col("docs")).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("blocks")).otherwise(F.col("outer"))).cast("int"))
    # the blocks of what is left come first; each meets every other block, while those inside meet only these
    dealt = dealt.withColumn("at", F.when(F.col("inside"), F.col("outer") + F.col("block")).otherwise(F.col("block")))
    others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("blocks") - 1))
    dealt = dealt.withColumn("other", F.explode(others)).withColumn("i", F.least("at", "other")).withColumn("j", F.greatest("at", "other"))
    return links.unionByName(compared(dealt))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """key, n_shingles, component_id and kept of every row."""
    whole_numbers(docs, key)
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    marked = saved(signatures(plain, "id", "text", size).withColumnRenamed("n_shingles", "n"), "near-signatures")
    used = marked.where("n > 0 AND id IS NOT NULL")
    classes = used.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    classed = looked_up(used.select("id", "n", "d1", "d2"), saved(classes, "near-equal"), ["d1", "d2", "n"], "docs", "left")
    classed = saved(classed.select("id", "n", "d1", "d2", F.coalesce("rep", "id").alias("rep")), "near-classes")
    alone = saved(classed.where("id = rep").select("id").distinct(), "near-reps")
    reps = used.select("id", "n", "d1", "d2", "sketch", "keys").join(small_side(alone), "id", "left_semi").dropDuplicates(["id", "d1", "d2", "n"])
    clusters = components(candidates(reps.drop("d1", "d2")), "near-clusters")
    links = confirmed(plain, clusters, "text", size)
    # an id with several texts is one node
    several = saved(classed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("id", "a"), "near-several")
    links = links.unionByName(classed.join(small_side(several), "id").select("a", F.col("rep").alias("b")).distinct())
    found = saved(components(links, "near-components").where("id <> label").select(F.col("id").alias("rep"), "label"), "near-found")
    out = classed.join(small_side(found), "rep", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
    rest = marked.where("n = 0 OR id IS NULL").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """docs with the rows of one id of each component: its least. Rows with a null id stay."""
    name = column_name(docs, "_gone")
    gone = saved(near_duplicates(docs, key, text, size).where("NOT kept").select(F.col(key).alias(name)).distinct(), "near-gone")
    return docs.join(small_side(gone), docs[key].cast("long") == F.col(name), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


#: Every pair that shares a shingle is counted here, and links are followed to the end.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE len(ws) WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ws
             ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS n, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""
