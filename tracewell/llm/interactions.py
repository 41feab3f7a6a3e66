"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Four filters judge a text alone: their bits come from one pass. The fifth, E, removes a text that a smaller id has too. Its
duplicates are found by partition refinement: rows are split by the code points of their texts, then by the hashes of
successive blocks (BLOCK code points, then GROWTH times as many each), and rows that are alone in their part drop out at
each step. Each hash takes in the one before, so a step groups by two numbers. Only what no block tells apart is compared by full text, in
a grouping that each task combines before the shuffle; so a text with a million copies is a row a task.

Then rows are counted by (part, mask of failed filters). Every order and step follows from those counts, of which there are
32 a part: a filter removes the rows that fail it and none before it.

Defined results: a null text counts as empty and a null source as ''. A null id has no smaller id and is none: E never
removes it, nor another for its sake. Rows that share an id and a text are not duplicates of each other; each counts. An id
with several label rows has a label if one of them says so. An empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, saved, small_side, text_map

FILTERS = "ABCDE"
#: Words that filter A asks for, per cent of distinct words (B), per cent of capitals (C), and the symbols of D.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, "#$%&*|"
#: Code points of the first block, and how many times the last each next one holds.
BLOCK, GROWTH = 256, 16
ORDERS = 120
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def bits_of(text: str) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at [\x20\x09-\x0D] only
    capitals = int(_CAPITAL[np.frombuffer(raw, np.uint8)].sum())
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * capitals > CAPITAL_PERCENT * len(text),
        any(s in text for s in SYMBOLS),
    )
    return sum(1 << k for k, f in enumerate(failed) if f)


def block_hashes(text: str) -> list[int]:
    """A hash of the text up to the end of each of its blocks."""
    out, at, size, h = [], 0, BLOCK, 0
    while at < len(text):
        h = xxhash.xxh3_64_intdigest(text[at : at + size].encode("utf-8", "surrogatepass"), seed=h)
        out.append(h - (1 << 63))
        at, size = at + size, size * GROWTH
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, h (with doc_id what a row is known by), length in code points, bits, blocks."""
    plain = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def make():
        return lambda texts: ((len(t), bits_of(t), block_hashes(t)) for t in texts)

    return saved(text_map(plain.withColumn("h", F.xxhash64("text")), ["doc_id", "part", "h"], "text", "length long, bits int, blocks array<long>", make), "audit-measured")


def refined(rows: DataFrame) -> DataFrame:
    """(doc_id, h, length, last): the rows that no block tells apart from another; last is the hash after the last block."""
    left = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "h", "length", "blocks")
    done, step = [], 0
    while True:
        key = F.lit(0).cast("long") if step == 0 else F.col("blocks")[step - 1]
        left = left.withColumn("last", key)
        several = saved(left.groupBy("length", "last").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "audit-parts")
        left = saved(looked_up(left, several, ["length", "last"], "n"), "audit-left")
        done.append(left.where(F.size("blocks") == step).drop("blocks"))
        left = left.where(F.size("blocks") > step)
        if left.isEmpty():
            break
        step += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.distinct()


def repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, h) of the rows whose text a smaller doc_id has too."""
    alike = saved(refined(rows), "audit-alike")
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = plain.join(small_side(alike), ["doc_id", "h"])
    part = ["length", "last"]
    groups = saved(texts.groupBy(*part, "text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "audit-texts")
    parts = saved(groups.groupBy(*part).agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n")), "audit-classes")
    later = F.col("doc_id") > F.col("first")
    out = looked_up(alike, parts.where("texts = 1").drop("texts"), part, "n").where(later).select("doc_id", "h")
    if not (mixed := parts.where("texts > 1").select(*part)).isEmpty():  # texts whose hashes meet
        own = groups.drop("n").join(mixed, part, "left_semi")
        out = out.unionByName(texts.join(own, [*part, "text"]).where(later).select("doc_id", "h"))
    return saved(out.distinct(), "audit-repeats")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of failed filters, and how many rows, good rows and toxic rows have it."""
    rows = measured(docs)
    again = repeats(docs, rows).withColumn("e", F.lit(1 << 4))
    known = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id")
    known = saved(known.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")), "audit-labels")
    rows = rows.select("doc_id", "h", "part", "bits").join(small_side(again), ["doc_id", "h"], "left").join(small_side(known), "doc_id", "left")
    rows = rows.withColumn("mask", F.col("bits").bitwiseOR(F.coalesce("e", F.lit(0))))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return saved(rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic")), "audit-masks")


def steps(spark) -> DataFrame:
    """A fixed table of 19,200 rows: what each order and step does to a mask."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            bit = 1 << k
            for m in range(1 << len(FILTERS)):
                fails, earlier = bool(m & bit), bool(m & before)
                rows.append((m, name, step, not m & (before | bit), fails and not earlier, fails and earlier, m == bit, ORDERS // m.bit_count() if fails else 0))
            before |= bit
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, stays boolean, goes boolean, gone boolean, alone boolean, share int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, filter_order and step, with the counts of the module's docstring."""
    rows = masks(docs, labels).join(F.broadcast(steps(docs.sparkSession)), "mask")  # a fixed table

    def total(where, what, name):
        return F.sum(F.when(F.col(where), F.col(what)).otherwise(F.lit(0))).cast("long").alias(name)

    return rows.groupBy("part", "filter_order", "step").agg(
        total("stays", "n", "kept"),
        total("goes", "n", "removed"),
        total("gone", "n", "redundant"),
        total("alone", "n", "unique_fails"),
        total("goes", "good", "good_lost"),
        total("goes", "toxic", "toxic_lost"),
        F.sum(F.col("n") * F.col("share")).cast("long").alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
k AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN k USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, '[' || substr(filter_order, 1, step - 1) || '0]' AS before FROM o, range(1, 6) r(step)),
j AS (SELECT part, filter_order, step, n, good, toxic, contains(fails, x) AS hit, regexp_matches(fails, before) AS earlier, fails = x AS alone, len(fails) AS many FROM c, s)
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT earlier), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE hit AND earlier), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS toxic_lost,
  (SELECT coalesce(sum(y.n), 0) FROM j y WHERE y.part = j.part AND substr(y.filter_order, y.step, 1) = substr(j.filter_order, j.step, 1) AND y.hit AND NOT y.earlier)::BIGINT AS shapley
FROM j GROUP BY part, filter_order, step
"""
