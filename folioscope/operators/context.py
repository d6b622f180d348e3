"""Packing ranked text into a size budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_prefix(df: DataFrame, group: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """The longest prefix of each group within budget; the first row always stays.

    Sizes are positive, so the running sum rises and cutting at the first overflow is a filter.
    """
    w = Window.partitionBy(group).orderBy(*order)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", running).withColumn("position", F.row_number().over(w)).where((F.col("running") <= budget) | (F.col("position") == 1))


def budget_share(df: DataFrame, side: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Two sides, 'a' and 'b', share a budget: b is promised its need up to a third, a takes the rest, b what a leaves.

    Every row stays, with `kept` and its place: kept rows of a, kept rows of b, then the rest of each.
    """
    w = Window.partitionBy(side).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("running", F.sum(size).over(w))
    need_b = F.coalesce(F.max(F.when(F.col(side) == "b", F.col("running"))).over(Window.partitionBy()), F.lit(0))
    rows = rows.withColumn("_reserved", F.least(need_b, F.lit(budget // 3)))
    rows = rows.withColumn("_kept_a", (F.col(side) == "a") & (F.col("running") <= budget - F.col("_reserved")))
    used_a = F.coalesce(F.max(F.when(F.col("_kept_a"), F.col("running"))).over(Window.partitionBy()), F.lit(0))
    rows = rows.withColumn("_used_a", used_a).withColumn("kept", F.col("_kept_a") | ((F.col(side) == "b") & (F.col("running") <= budget - F.col("_used_a"))))
    place = F.row_number().over(Window.orderBy(F.when(F.col("kept"), 0).otherwise(1), side, *order))
    return rows.withColumn("place", place).drop("_reserved", "_kept_a", "_used_a")


def neighbours(hits: DataFrame, rows: DataFrame, group: str, place: str, key: str, order: str) -> DataFrame:
    """Previous, hit and next of each hit in place order; an id already given is skipped; neighbours carry the hit's order."""
    wanted = hits.select(F.col(group), F.col(order), F.col(key).alias("_hit"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("offset"), F.col(place).alias("_at"))
    wanted = wanted.withColumn(place, F.col("_at") + F.col("offset")).drop("_at")
    found = wanted.join(rows.select(group, place, key), [group, place])
    first = F.row_number().over(Window.partitionBy(key).orderBy(order, "offset"))
    kept = found.withColumn("_n", first).where("_n = 1").drop("_n")
    return kept.withColumn("neighbour_of", F.when(F.col("offset") != 0, F.col("_hit"))).drop("_hit")
