"""Outlines: what stands below what in an ordered list of ranked rows, and references to numbered places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parents(rows: DataFrame, group: str, order: list[str], key: str, rank: Column, ranks: int) -> DataFrame:
    """(key, parent): the last row before each row of its group that has a lower rank; null where there is none.

    Ranks go from 0 to ranks - 1; one sort serves all of them. Rows of a null rank are no parents and have none.
    """
    before = Window.partitionBy(group).orderBy(*order, key).rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order, key))
    ranked = rows.withColumn("_rank", rank).withColumn("_place", place)
    last = [F.last(F.when(F.col("_rank") == r, F.struct("_place", F.col(key).alias("key"))), ignorenulls=True).over(before) for r in range(ranks)]
    seen = ranked.withColumn("_last", F.array(*last))
    lower = F.array_max(F.array_compact(F.slice("_last", F.lit(1), F.coalesce(F.col("_rank"), F.lit(0)))))
    return seen.select(key, lower["key"].alias("parent"))


def prefixes(number: Column, least: int) -> Column:
    """A dotted number and its beginnings of at least so many levels, e.g. 3.3.4, 3.3 of 3.3.4 for two."""
    parts = F.split(number, r"\.")
    lengths = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: n >= least)
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def most_specific(references: DataFrame, places: DataFrame, least: int = 2) -> DataFrame:
    """(id, reference, place): each reference (id, reference) with the longest of its beginnings that is a place; null if none is."""
    found = references.toDF("id", "reference").distinct()
    tried = found.withColumn("place", F.explode(prefixes(F.col("reference"), least))).join(places.toDF("place").distinct(), "place", "left_semi")
    best = tried.groupBy("id", "reference").agg(F.max_by("place", F.length("place")).alias("place"))
    return found.join(best, ["id", "reference"], "left")
