"""Running totals in one global order, and the rows at which they pass a limit.

No task sees all rows: they are dealt by ranges of the order, each range adds up its own amounts, a window over the few ranges
gives what comes before each, and the running total of a row is that and what precedes the row in its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialized


def running(rows: DataFrame, order: list[str], totals: dict[str, Column]) -> DataFrame:
    """rows with each total's sum over all rows up to and with this one, by order, which is to be total for a defined result."""
    given = rows.columns
    dealt = rows.select("*", *[c.alias(f"_{name}") for name, c in totals.items()])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialized(dealt.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "budget-ranges")
    own = dealt.groupBy("_range").agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in totals])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    ahead = own.select("_range", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in totals])
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(ahead), "_range")  # a row a range
    return placed.select(*given, *[(F.col(f"_before_{name}") + F.sum(f"_{name}").over(here)).alias(name) for name in totals])


def passed(rows: DataFrame, order: list[str], amount: Column, step: int, total: str = "total") -> DataFrame:
    """The rows at which the running total passes a multiple of step, with the total."""
    own = running(rows.withColumn("_amount", amount), order, {total: F.col("_amount")})
    return own.where(F.floor(F.col(total) / step) > F.floor((F.col(total) - F.col("_amount")) / step)).drop("_amount")


def first_fault(rows: DataFrame, order: list[str], totals: dict[str, Column], faults: list[tuple[str, Column]]) -> DataFrame:
    """The first row, by order, with a fault, and its code: of several at one row, the first of the list counts. Faults may speak of
    the running totals."""
    code = F.lit(None).cast("string")
    for name, is_fault in reversed(faults):
        code = F.when(is_fault, F.lit(name)).otherwise(code)
    return running(rows, order, totals).withColumn("code", code).where("code IS NOT NULL").orderBy(*order).limit(1)
