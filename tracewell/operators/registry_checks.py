"""Relation registries: consistency by self-joins, and their compilation to orientation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id string, acyclic boolean, inverse string, descent string"


def findings(registry: DataFrame) -> DataFrame:
    """(id, code) of a registry (SCHEMA): repeated ids, inverses that are not registered, do not answer, or descend alike."""
    twice = registry.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("REGISTRY_DUPLICATE_ID").alias("code"))
    named = registry.where("inverse IS NOT NULL").alias("a").join(registry.alias("b"), F.col("a.inverse") == F.col("b.id"), "left")
    code = (
        F.when(F.col("b.id").isNull(), "REGISTRY_INVERSE_UNKNOWN")
        .when(~F.col("b.inverse").eqNullSafe(F.col("a.id")), "REGISTRY_INVERSE_NOT_RECIPROCAL")
        .when(F.col("a.descent") == F.col("b.descent"), "REGISTRY_INVERSE_SAME_DIRECTION")
    )
    return twice.unionByName(named.select(F.col("a.id").alias("id"), code.alias("code")).where("code IS NOT NULL").distinct())


def orientations(registry: DataFrame) -> DataFrame:
    """(predicate, canonical, reverse) of acyclic relations: of a pair of inverses the first by place in the registry
    (column place) is canonical and the other is read backwards."""
    a = registry.where("acyclic").select("id", "inverse", "place")
    pairs = a.join(a.select(F.col("id").alias("inverse"), F.col("place").alias("other")), "inverse", "left")
    back = F.coalesce(F.col("other") < F.col("place"), F.lit(False))
    return pairs.select(F.col("id").alias("predicate"), F.when(back, F.col("inverse")).otherwise(F.col("id")).alias("canonical"), back.alias("reverse"))
