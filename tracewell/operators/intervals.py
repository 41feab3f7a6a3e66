"""Joins of points with the intervals that hold them, and what policies permit at a time.

An interval gets the level of its length, the least power of two that is no shorter, and lies in two bins of that width at most.
A point looks into its one bin of each level that any interval has. So an equi-join finds every pair, whatever the mix of long
and short intervals: intervals double at most, points are repeated once per level in use (64 at most), and no bin width is to be chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialized

#: Bounds that stand for an open end; what lies beyond them is not met.
LEAST, GREATEST = -(1 << 61), 1 << 61
#: Times whose bits above these are equal add up in one window.
BIN_BITS = 16


def _level(begin: Column, end: Column) -> Column:
    """The least n with end - begin + 1 <= 2**n, from the digits of a binary number."""
    return F.when(end == begin, F.lit(0)).otherwise(F.length(F.bin(end - begin)))


def within(points: DataFrame, spans: DataFrame, on: list[str], at: str, begin: str, end: str) -> DataFrame:
    """points joined with the spans of equal keys that hold them: begin <= at <= end, all whole numbers. A null begin or end is
    open; a span that ends before it begins holds nothing; a null point is nowhere. Other columns are to have different names."""
    low, high = F.coalesce(F.greatest(F.col(begin), F.lit(LEAST)), F.lit(LEAST)), F.coalesce(F.least(F.col(end), F.lit(GREATEST)), F.lit(GREATEST))
    s = spans.withColumn("_low", low).withColumn("_high", high).where("_low <= _high").withColumn("_level", _level(F.col("_low"), F.col("_high")))
    levels = [r[0] for r in s.select("_level").distinct().collect()]  # 64 at most
    first, last = (F.expr(f"shiftright({c}, _level)") for c in ("_low", "_high"))
    s = s.withColumn("_bin", F.explode(F.array_distinct(F.array(first, last))))
    looks = F.array(*[F.struct(F.lit(n).alias("_level"), F.expr(f"shiftright(cast({at} AS bigint), {n})").alias("_bin")) for n in levels] or [F.lit(None).cast("struct<_level:int,_bin:bigint>")])
    p = points.where(F.col(at).isNotNull()).withColumn("_look", F.explode(looks)).select("*", "_look.*").drop("_look")
    met = p.join(s, [*on, "_level", "_bin"]).where((F.col(at) >= F.col("_low")) & (F.col(at) <= F.col("_high")))
    return met.drop("_level", "_bin", "_low", "_high")


def covering(points: DataFrame, spans: DataFrame, on: list[str], at: str, begin: str, end: str, counts: list[str]) -> DataFrame:
    """The distinct (on.., at) of points, with the sums of the spans' counts over those that
    hold them; keys and times as in within(). No pair is made: a span adds at its begin and takes away after its end, changes at
    one time are one row, and a running sum meets the points. Rows of a key are as many as its different times; the running sum
    goes over bins of them first, so that a key with many times is no single task's."""
    low, high = F.coalesce(F.greatest(F.col(begin), F.lit(LEAST)), F.lit(LEAST)), F.coalesce(F.least(F.col(end), F.lit(GREATEST)), F.lit(GREATEST))
    s = spans.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    for c in on:
        s = s.where(F.col(c).isNotNull())
    change = lambda time, sign: F.struct(time.cast("long").alias("_at"), *[(F.lit(sign) * F.col(c)).alias(c) for c in counts])
    changes = s.select(*on, F.explode(F.array(change(F.col("_low"), 1), change(F.col("_high") + 1, -1))).alias("_c")).select(*on, "_c.*")
    asked = points.select(*on, F.col(at).cast("long").alias("_at"), *[F.lit(0).cast("long").alias(c) for c in counts], F.lit(True).alias("_asked")).where("_at IS NOT NULL").distinct()
    rows = changes.withColumn("_asked", F.lit(False)).unionByName(asked)
    rows = rows.groupBy(*on, "_at").agg(*[F.sum(c).alias(c) for c in counts], F.bool_or("_asked").alias("_asked")).withColumn("_bin", F.expr(f"shiftright(_at, {BIN_BITS})"))
    rows = materialized(rows, "interval-changes")  # read twice
    whole = Window.partitionBy(*on).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*on, "_bin").agg(*[F.sum(c).alias(c) for c in counts])
    bins = bins.select(*on, "_bin", *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"_before_{c}") for c in counts])
    here = Window.partitionBy(*on, "_bin").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.select(*on, "_bin", "_at", "_asked", *[F.sum(c).over(here).alias(c) for c in counts]).where("_asked")
    return told.join(bins, [*on, "_bin"]).select(*on, F.col("_at").alias(at), *[(F.col(c) + F.col(f"_before_{c}")).alias(c) for c in counts])


def authorizations(evaluations: DataFrame, rules: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """keep, permissions, prohibitions and verdict of every evaluation (keep, on.., action, target, at): how many rules (on..,
    effect, action, target, valid_from, valid_until) of each effect aim at its target and its action and were valid at its time.
    It is permitted if some rule permits it and none forbids it; a rule without a target aims at all. Times are whole numbers.

    Rules are counted, not paired with evaluations: work grows with both sides' rows, however many rules hold at a time."""
    key, effects = [*on, "action"], {"permissions": "permission", "prohibitions": "prohibition"}
    given = rules.select(*key, "target", "valid_from", "valid_until", *[(F.col("effect") == e).cast("long").alias(n) for n, e in effects.items()]).fillna(0, list(effects))
    asked = evaluations.select(*keep, *key, "target", F.col("at").cast("long").alias("at"))
    aimed = covering(asked.where("target IS NOT NULL"), given.where("target IS NOT NULL"), [*key, "target"], "at", "valid_from", "valid_until", list(effects))
    general = covering(asked, given.where("target IS NULL").drop("target"), key, "at", "valid_from", "valid_until", list(effects))
    own = lambda df, prefix: df.select(*[c for c in df.columns if c not in effects], *[F.col(n).alias(f"{prefix}{n}") for n in effects])
    out = asked.join(own(aimed, "_a_"), [*key, "target", "at"], "left").join(own(general, "_g_"), [*key, "at"], "left")
    out = out.groupBy(*keep).agg(*[F.sum(F.coalesce(f"_a_{n}", F.lit(0)) + F.coalesce(f"_g_{n}", F.lit(0))).alias(n) for n in effects])
    verdict = F.when(F.col("prohibitions") > 0, "prohibited").when(F.col("permissions") > 0, "permitted").otherwise("unauthorised")
    return out.withColumn("verdict", verdict)
