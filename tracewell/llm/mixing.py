"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

The words of a mix are dealt in blocks of BLOCK words. Each source's words lie, in a seeded order of its documents, on
the tapes of its shards. The blocks of the mix are seats: first the sources, by their targets, and then the shards of
each source, by their sizes, get integer quotas by the highest quotients v / (2 s + 1). A shard's quota is taken from
its endless tape, one block after another from a seeded block on, so that a document's words come once per lap.

Sizes are counted once and saved; everything after that works on rows of a few numbers. A source is split into shards by
hash before any window sorts its documents, so that a large source is many windows.

Defined results: a null text has no words; a null source is a source of its own, ordered last; documents without words
take nothing; a table without words has targets and takes of 0; an empty table gives an empty mix. Rows that repeat an
id are separate documents. The seed fixes every choice; ties between quotients go to the source or shard that comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column_name, saved, small_side

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 32
#: Words of a shard at least, and shards of a mix (besides one per source) at most.
SHARD_WORDS, SHARDS = 1 << 18, 100_000
SEED = "mix"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hash(*parts: Column) -> Column:
    """A seeded number below 2**32, from the MD5 of the parts' texts."""
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *texts).cast("binary")), 1, 8), 16, 10).cast("long")


def _running(w) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sources(sizes: DataFrame) -> DataFrame:
    """Per source: its place by code point (null last), size, weight, target and number of shards."""
    whole = Window.partitionBy()
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", "place")
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("place", F.row_number().over(by_name).cast("long") - 1).withColumn("total", F.sum("source_size").over(whole))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    t = t.withColumn("most", MOST * F.col("source_size")).withColumn("level", F.col("most").cast("double") / F.col("weight"))
    # sources in the order in which a rising level fills them: the first that the level of the rest does not overfill sets it
    t = t.withColumn("full_most", F.sum("most").over(_running(by_level)) - F.col("most")).withColumn("full_weight", F.sum("weight").over(_running(by_level)) - F.col("weight"))
    t = t.withColumn("rest", (F.lit(SHARE) * F.col("total") - F.col("full_most")) / (F.sum("weight").over(whole) - F.col("full_weight")))
    t = t.withColumn("mark", F.min(F.when(F.col("rest") <= F.col("level"), F.struct("level", "place", "rest"))).over(whole))
    t = t.withColumn("target", F.least(F.col("most").cast("double"), F.col("mark.rest") * F.col("weight")))
    per_shard = F.greatest(F.lit(SHARD_WORDS), F.ceil(F.col("total") / SHARDS))
    return t.select("source", "place", "source_size", "total", F.coalesce("target", F.lit(0.0)).alias("target"), F.greatest(F.ceil(F.col("source_size") / per_shard), F.lit(1)).cast("long").alias("shards"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, quota: str) -> DataFrame:
    """parties with the column quota: the seats of each group dealt to its parties by the highest quotients
    votes / (2 s + 1). The last seat's quotient lies between V / (N + P / 2) and V / (N - P / 2), for V votes, N seats and
    P parties; seats above that range are certain, and only the few quotients inside it, about three a party, are ranked."""
    g = Window.partitionBy(*group)
    p = parties.withColumn("_v", F.sum(votes).over(g)).withColumn("_p", F.count(F.lit(1)).over(g) / 2.0)
    share = lambda seats_left: F.floor(F.col(votes) * seats_left / F.col("_v") + 0.5)
    few = F.when(F.col("_v") > 0, F.greatest(share(F.col(seats) - F.col("_p")) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long")
    many = F.when(F.col("_v") > 0, share(F.col(seats) + F.col("_p")) + 1).otherwise(F.lit(0)).cast("long")
    p = p.withColumn("_few", few).withColumn("_many", many).withColumn("_left", F.col(seats) - F.sum("_few").over(g)).drop("_v", "_p")
    q = p.where((F.col("_many") > F.col("_few")) & (F.col(votes) > 0)).select(*group, party, votes, "_left", F.explode(F.sequence("_few", F.col("_many") - 1)).alias("_s"))
    q = q.withColumn("_q", F.col(votes).cast("double") / (2 * F.col("_s") + 1))
    q = q.withColumn("_n", F.row_number().over(g.orderBy(F.col("_q").desc(), party))).where(F.col("_n") <= F.col("_left"))
    won = q.groupBy(*group, party).agg(F.count(F.lit(1)).alias("_won"))
    return p.join(won, [*group, party], "left").withColumn(quota, F.col("_few") + F.coalesce("_won", F.lit(0))).drop("_few", "_many", "_left", "_won")


def takes(sizes: DataFrame) -> DataFrame:
    """sizes (doc_id, source, size) with source_size, target, taken, and what was taken: laps over the whole document and
    the stretches [cut_from, cut_to) and [0, wrap_to) of its words."""
    s = sources(sizes)
    s = sainte_lague(s.withColumn("_all", F.lit(0)).withColumn("seats", F.round(F.lit(SHARE) * F.col("total") / BLOCK).cast("long")), ["_all"], "place", "target", "seats", "blocks")
    s = saved(s, "mix-sources")
    d = sizes.join(s.select(F.col("source").alias("_source"), "place", "source_size", "target", "shards", "blocks"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("shard", _hash(F.lit("shard"), F.col("doc_id")) % F.col("shards"))
    h = d.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    h = sainte_lague(h, ["place"], "shard", "shard_size", "blocks", "quota")
    h = saved(h, "mix-quotas")
    h = h.withColumn("take", F.least(F.col("quota") * BLOCK, MOST * F.col("shard_size")))
    h = h.withColumn("laps", F.when(F.col("shard_size") > 0, F.floor(F.col("take") / F.col("shard_size"))).otherwise(F.lit(0)))
    h = h.withColumn("run", F.col("take") - F.col("laps") * F.col("shard_size"))
    h = h.withColumn("begin", F.when(F.col("shard_size") > 0, BLOCK * (_hash(F.lit("begin"), F.col("place"), F.col("shard")) % F.ceil(F.col("shard_size") / BLOCK))).otherwise(F.lit(0)))
    d = d.drop("blocks", "shards").join(h.select("place", "shard", "shard_size", "laps", "run", "begin"), ["place", "shard"])
    order = Window.partitionBy("place", "shard").orderBy(_hash(F.lit("order"), F.col("doc_id")), "doc_id", "size")
    at = F.sum("size").over(_running(order)) - F.col("size")
    d = d.withColumn("at", at)
    end = F.col("begin") + F.col("run")
    within = lambda x: F.least(F.greatest(x - F.col("at"), F.lit(0)), F.col("size"))
    d = d.withColumn("cut_from", within(F.col("begin"))).withColumn("cut_to", within(end)).withColumn("wrap_to", within(end - F.col("shard_size")))
    taken = F.col("laps") * F.col("size") + F.col("cut_to") - F.col("cut_from") + F.col("wrap_to")
    return d.withColumn("taken", taken.cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    return saved(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")), "mix-sizes")


def mix(docs: DataFrame) -> DataFrame:
    return takes(measure(docs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, length: str = "n_chars") -> DataFrame:
    """docs as the mix takes them, with the columns of docs: a row's text is its whole text once per lap, then the words of
    its cut stretches; length, where it is a column, counts anew. Rows of which nothing is taken go. Rows that share id,
    source and size are taken alike."""
    t = takes(measure(docs)).where("taken > 0").dropDuplicates(["doc_id", "source", "size"])
    mine = {c: column_name(docs, f"_mix_{c}") for c in ("doc_id", "source", "size", "laps", "cut_from", "cut_to", "wrap_to")}
    t = saved(t.select(*[F.col(c).alias(name) for c, name in mine.items()]), "mix-takes")
    of = {c: F.col(name) for c, name in mine.items()}
    same = docs["doc_id"].eqNullSafe(of["doc_id"]) & docs["source"].cast("string").eqNullSafe(of["source"]) & (words(docs["text"]) == of["size"])
    joined = docs.join(small_side(t), same)
    w = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))

    def stretch(start: Column, stop: Column) -> Column:
        part = F.concat_ws(" ", F.slice(w, (start + 1).cast("int"), (stop - start).cast("int")))
        return F.when((start == 0) & (stop == of["size"]), F.col("text")).when(stop > start, part)

    laps = F.array_repeat(F.col("text"), of["laps"].cast("int"))
    text = F.concat_ws("\n", laps, stretch(of["cut_from"], of["cut_to"]), stretch(F.lit(0), of["wrap_to"]))
    out = joined.withColumn("text", text).select(*docs.columns)
    return out.withColumn(length, F.length("text").cast(docs.schema[length].dataType)) if length in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 8))::BIGINT"


#: Quotients are all enumerated here, not only those near the last seat.
SQL = rf"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY 1),
b AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, (sum(source_size) OVER ())::BIGINT AS total FROM a),
c AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {MOST} * source_size AS most FROM b),
e AS (SELECT *, most::DOUBLE / weight AS level FROM c),
f AS (SELECT *, (sum(most) OVER w - most)::BIGINT AS full_most, (sum(weight) OVER w - weight)::BIGINT AS full_weight, (sum(weight) OVER ())::BIGINT AS weights
      FROM e WINDOW w AS (ORDER BY level, place ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, ({SHARE}::DOUBLE * total - full_most) / (weights - full_weight) AS rest FROM f),
s AS (SELECT source, place, source_size, total, coalesce(least(most::DOUBLE, (SELECT rest FROM g WHERE rest <= level ORDER BY level, place LIMIT 1) * weight), 0) AS target,
             greatest(ceil(source_size / greatest({SHARD_WORDS}, ceil(total / {SHARDS}))), 1)::BIGINT AS shards FROM g),
sq AS (SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS n, total
       FROM (SELECT place, target, total, unnest(range(0, (ceil(target / {BLOCK}) + (SELECT count(*) FROM s) + 2)::BIGINT)) AS k FROM s WHERE target > 0)),
sb AS (SELECT place, count(*) AS blocks FROM sq WHERE n <= round({SHARE} * total / {BLOCK}) GROUP BY 1),
d AS (SELECT z.doc_id, z.size, s.place, s.source_size, s.target, coalesce(sb.blocks, 0) AS blocks,
             {_sql_hash("'shard'", "coalesce(z.doc_id::VARCHAR, 'null')")} % s.shards AS shard
      FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source LEFT JOIN sb ON sb.place = s.place),
h AS (SELECT place, shard, sum(size)::BIGINT AS shard_size, first(blocks) AS blocks, count(*) OVER (PARTITION BY place) AS parties FROM d GROUP BY 1, 2),
hq AS (SELECT place, shard, blocks, row_number() OVER (PARTITION BY place ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard) AS n
       FROM (SELECT *, unnest(range(0, (ceil(shard_size * blocks / (sum(shard_size) OVER (PARTITION BY place))) + parties + 2)::BIGINT)) AS k FROM h WHERE shard_size > 0)),
hb AS (SELECT place, shard, count(*) AS quota FROM hq WHERE n <= blocks GROUP BY 1, 2),
t AS (SELECT h.place, h.shard, shard_size, least(coalesce(quota, 0) * {BLOCK}, {MOST} * shard_size) AS take,
             CASE WHEN shard_size > 0 THEN {BLOCK} * ({_sql_hash("'begin'", "h.place::VARCHAR", "h.shard::VARCHAR")} % ceil(shard_size / {BLOCK})::BIGINT) ELSE 0 END AS start
      FROM h LEFT JOIN hb ON h.place = hb.place AND h.shard = hb.shard),
u AS (SELECT *, CASE WHEN shard_size > 0 THEN take // shard_size ELSE 0 END AS laps FROM t),
v AS (SELECT *, start + take - laps * shard_size AS stop FROM u),
x AS (SELECT d.*, v.shard_size, v.laps, v.start, v.stop, (sum(size) OVER (PARTITION BY d.place, d.shard
             ORDER BY {_sql_hash("'order'", "coalesce(doc_id::VARCHAR, 'null')")}, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos
      FROM d JOIN v ON d.place = v.place AND d.shard = v.shard)
SELECT doc_id, size, source_size, target, (laps * size + least(greatest(stop - pos, 0), size) - least(greatest(start - pos, 0), size)
       + least(greatest(stop - shard_size - pos, 0), size))::BIGINT AS taken FROM x
"""
