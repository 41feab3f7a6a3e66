"""Source divergence audit by a baseline-corrected inverted index.

A term is a run of letters (ASCII letters, with A-Z lower-cased, and all that is not ASCII). A language keeps the terms that
are in LEAST_DOCS of its documents, V of them. A source of a language, and the language itself, give each kept term the
smoothed share p = 1 + floor(SCALE (count + 1) / (N + V)); f(p, q) = floor((p - q)^2 / q).

Pairs of sources sum f over all kept terms, but no pair looks at every term. A pair starts at V times f of two zero counts. The
terms' postings then add what differs from that: a source's terms, grouped by their count, against the zero count of every other
source of the language; and, for two sources that share a term, what their two counts add beyond those two. Only these
last are made term by term, and only where they are not zero. Sums are whole numbers, so their order does not matter.

Terms of a source that it uses more than its language are ranked in a window, of which only the first TOP leave a task.

Numbers: SCALE (count + 1) is a decimal; p is at most SCALE + 1 and the sum of a source's p at most SCALE + V, so every f
and every sum of them is a long. Spark's ANSI mode reports an overflow, should V pass a billion.

Defined results: null text, lang and source are ''. A group without terms has N = 0; where V = 0, every value of a pair is 0
and no term is ranked. Equal rows are documents of their own. A language of one source has no pair. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, mapped, saved, small_side

LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Counts, and bytes of terms, that a task gathers before it hands them on.
HELD, HELD_BYTES = 300_000, 32 << 20
_LETTERS = bytes((c | 32 if 65 <= c <= 90 else c) if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, several rows a term; and a row with the term '' a group."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        groups: dict = {}
        size = 0

        def rows():
            for (lang, source), (n, d) in groups.items():
                yield lang, source, b"", 0, 0
                for term, k in n.items():
                    yield lang, source, term, k, d[term]

        def out():
            cols = list(zip(*rows(), strict=True))
            term = pa.array(cols[2], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), term, pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=names)

        try:
            for b in batches:
                for lang, source, text in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                    n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                    words = terms_of(text)
                    before = len(n)
                    n.update(words)
                    own = set(words)
                    d.update(own)
                    size += (len(n) - before) + (sum(map(len, own)) * HELD // HELD_BYTES if len(text) > 100_000 else 0)
                    if size > HELD:
                        yield out()
                        groups.clear()
                        size = 0
            if groups:
                yield out()
        finally:
            groups.clear()
            give_back()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return mapped(docs.select(*plain), run, "lang string, source string, term string, n long, docs long")


def postings(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, total, first) of kept terms, total over the language, first: whether it is the term's first
    posting; and a row with the term '' a group. A term's postings meet in one place, of which there is one a source."""
    term = Window.partitionBy("lang", "term")
    # every task has summed its own rows, so they are dealt by term at once, and both groupings and the window use that
    rows = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = rows.withColumn("total", F.sum("n").over(term)).withColumn("docs", F.sum("docs").over(term)).withColumn("first", F.col("source") == F.min("source").over(term))
    return saved(rows.where((F.col("docs") >= LEAST_DOCS) | (F.col("term") == "")).drop("docs"), "divergence-postings")


def share(count: Column, total: Column, v: Column) -> Column:
    """p, from the count of a term, the count of all kept terms and V."""
    whole = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(total + v > 0, 1 + F.call_function("div", whole, F.greatest(total + v, F.lit(1)).cast("decimal(19,0)")))


def f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(rows: DataFrame) -> DataFrame:
    """Per (lang, source): group_n, zero (the share of a count of 0), and the language's v and lang_n."""
    real = F.col("term") != ""
    g = rows.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.sum((F.col("first") & real).cast("long")).alias("firsts"))
    whole = Window.partitionBy("lang")
    g = g.withColumn("v", F.sum("firsts").over(whole)).withColumn("lang_n", F.sum("group_n").over(whole)).drop("firsts")
    return saved(g.withColumn("zero", share(F.lit(0), F.col("group_n"), F.col("v"))), "divergence-groups")


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: the part 'pair' ranks the other sources of the language, the part 'term' the
    TOP terms that the source uses more than its language."""
    every = postings(docs)
    groups = groups_of(every)
    kept = every.where("term <> ''").join(small_side(groups), ["lang", "source"])
    kept = kept.select("lang", "source", "term", "n", "zero", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    return terms(kept).unionByName(pairs(kept, groups))


def terms(kept: DataFrame) -> DataFrame:
    more = kept.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))
    return ranked(more).where(F.col("rank") <= TOP)


def ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(w))


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    a, b, za, zb, pa_, pb = (F.col(c) for c in ("a", "b", "za", "zb", "pa", "pb"))
    two = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), "v").join(groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb")), "lang").where("a <> b")
    start = two.select("lang", "a", "b", F.when(F.col("v") > 0, F.col("v") * f(za, zb)).otherwise(F.lit(0)).alias("value"))
    # terms of one source with the same count change every pair with another source alike
    counts = kept.groupBy("lang", F.col("source").alias("a"), F.col("zero").alias("za"), F.col("p").alias("pa")).agg(F.count(F.lit(1)).alias("terms"))
    lone = counts.join(small_side(groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"))), "lang").where("a <> b")
    lone = lone.select("lang", "a", "b", (F.col("terms") * (f(pa_, zb) - f(za, zb))).alias("ab"), (F.col("terms") * (f(zb, pa_) - f(zb, za))).alias("ba"))
    side = lambda x: kept.select("lang", "term", F.col("source").alias(x), F.col("zero").alias(f"z{x}"), F.col("p").alias(f"p{x}"))
    both = side("a").join(side("b"), ["lang", "term"]).where("a < b")
    both = both.select("lang", "a", "b", (f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb)).alias("ab"), (f(pb, pa_) - f(pb, za) - f(zb, pa_) + f(zb, za)).alias("ba"))
    both = both.where("ab <> 0 OR ba <> 0")
    summed = [x.groupBy("lang", "a", "b").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba")) for x in (lone, both)]
    way = lambda x, one, other, value: x.select("lang", F.col(one).alias("a"), F.col(other).alias("b"), F.col(value).alias("value"))
    for x in summed:
        start = start.unionByName(way(x, "a", "b", "ab")).unionByName(way(x, "b", "a", "ba"))
    out = start.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return ranked(out.select("lang", a.alias("source"), F.lit("pair").alias("part"), b.alias("item"), "value"))


def query(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair is summed over every kept term here.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
             row_number() OVER () AS doc FROM documents),
o AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + v.v) AS p,
             1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
           LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM y)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
