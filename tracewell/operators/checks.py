"""Integrity checks as DataFrame operations; each returns the rows that fail, or rows with a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unresolved(refs: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """References that resolve to nothing; null references are not references."""
    present = refs
    for c in on:
        present = present.where(F.col(c).isNotNull())
    return present.join(known.select(*on).distinct(), on, "left_anti")


def wrong_type(refs: DataFrame, known: DataFrame, on: list[str], kind: str = "kind", expected: str = "expected") -> DataFrame:
    """References that resolve to an entity of a kind that is not expected; unresolved ones are not reported here."""
    return refs.join(known, on).where(~F.array_contains(expected, F.col(kind)))


def repeated(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Every row but the first of its key; order must be total for a defined result."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def not_rising(rows: DataFrame, group: list[str], order: list[Column], value: str, against: str = "running") -> DataFrame:
    """Rows whose value is not above the greatest before it ("running") or the one before it ("previous")."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)) if against == "running" else F.lag(value).over(w)
    return rows.withColumn("_before", before).where(F.col(value) <= F.col("_before")).drop("_before")


def uncovered(declared: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Keys that only one side has, with the side that has them."""
    a = declared.select(*on).distinct().withColumn("_a", F.lit(True))
    b = actual.select(*on).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, on, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(*on, F.when(F.col("_a").isNull(), F.lit("actual")).otherwise(F.lit("declared")).alias("side"))


def occurrences(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Each declared key with how often it was found (0 included), and whether that is exactly once."""
    n = found.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return declared.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("once"))


def counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows per collection; empty collections count 0."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def verdicts(subjects: DataFrame, diagnostics: DataFrame, key: str) -> DataFrame:
    """valid per subject: it has no diagnostic of severity error. Subjects without diagnostics stay, and are valid."""
    bad = diagnostics.groupBy(key).agg(F.bool_or(F.col("severity") == "error").alias("bad"), F.count(F.lit(1)).alias("n_diagnostics"))
    return subjects.select(key).distinct().join(bad, key, "left").select(key, (~F.coalesce("bad", F.lit(False))).alias("valid"), F.coalesce("n_diagnostics", F.lit(0)).alias("n_diagnostics"))


def distinct_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """One of each diagnostic, sorted as people read: by path, code, schema path and message, in the root collation."""
    d = diagnostics.withColumn("_s", F.coalesce("schema_path", F.lit(""))).dropDuplicates(["code", "severity", "instance_path", "_s", "message"])
    return d.orderBy(*[F.collate(c, "UNICODE") for c in ("instance_path", "code", "_s", "message")]).drop("_s")


def multimap(edges: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Per key its values in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return edges.groupBy(key).agg(F.transform(pairs, lambda x: x["v"]).alias("values"))


def path_prefixes(path: Column) -> Column:
    """All proper ancestors of a slash-separated path."""
    parts = F.split(path, "/")
    ends = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def path_collisions(paths: DataFrame, column: str = "path") -> DataFrame:
    """Paths that are, folded, another path's ancestor."""
    folded = paths.select(F.col(column).alias("path"), F.lower(column).alias("folded")).distinct()
    above = folded.select(F.explode(path_prefixes(F.col("folded"))).alias("folded")).distinct()
    return folded.join(above, "folded", "left_semi").select("path")
