"""Strings that differ little, found by equality joins and verified by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(c: Column) -> Column:
    """A string and what is left of it without one of its letters; strings one edit apart share one of these."""
    left_out = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, left_out).otherwise(F.array().cast("array<string>"))))


def one_edit_apart(rare: DataFrame, usual: DataFrame) -> DataFrame:
    """(word, close): words of two one-column tables that differ by one inserted, left out or replaced letter.

    Null words are left out; a word is not close to itself; repeated words count once.
    """
    a = rare.toDF("word").where("word is not null").distinct().withColumn("_key", F.explode(deletions(F.col("word"))))
    b = usual.toDF("close").where("close is not null").distinct().withColumn("_key", F.explode(deletions(F.col("close"))))
    return a.join(b, "_key").where((F.col("word") != F.col("close")) & (F.levenshtein("word", "close") <= 1)).select("word", "close").distinct()


def alike(labels: DataFrame, ratio: float) -> DataFrame:
    """(id, other, edits) of labels (id, label) whose edit distance is at most (1 - ratio) of the longer one's length; each pair in both directions.

    A label of n letters is cut into one segment more than it may have edits, so that one of them stands unchanged in
    any shorter label alike, moved by no more places than there are edits; those are joined by equality and verified.
    Empty and null labels are left out; equal labels of different ids are alike.
    """
    rows = labels.toDF("id", "label").where("label <> ''").withColumn("n", F.length("label"))
    lengths = rows.select("n").distinct()
    k = F.floor(F.col("n") * (1 - ratio) + 1e-9).cast("int")
    places = lengths.withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), F.least("k", F.col("n") - 1))))
    start = F.floor(F.col("i") * F.col("n") / (F.col("k") + 1)).cast("int") + 1
    end = F.floor((F.col("i") + 1) * F.col("n") / (F.col("k") + 1)).cast("int")
    places = places.withColumn("at", start).withColumn("width", end - start + 1).where("width > 0")
    longer = rows.join(places, "n").select(F.col("n").alias("_n"), "i", F.col("label").substr(F.col("at"), F.col("width")).alias("_piece"), F.col("id").alias("_long"), F.col("label").alias("_x"))
    shorter = rows.join(places.select(F.col("n").alias("_n"), "k", "i", "at", "width"), (F.col("n") <= F.col("_n")) & (F.col("n") >= F.col("_n") - F.col("k")))
    low, high = F.greatest(F.lit(1), F.col("at") - F.col("k")), F.least(F.col("n") - F.col("width") + 1, F.col("at") + F.col("k"))
    shorter = shorter.where(low <= high).withColumn("_p", F.explode(F.sequence(low, high))).select("_n", "i", F.col("label").substr(F.col("_p"), F.col("width")).alias("_piece"), "k", F.col("id").alias("_short"), F.col("label").alias("_y"))
    found = longer.join(shorter, ["_n", "i", "_piece"]).where("_long <> _short").select("_long", "_short", "_x", "_y", "k").distinct()
    edits = found.withColumn("edits", F.levenshtein("_x", "_y")).where("edits <= k")
    both = edits.select(F.col("_long").alias("id"), F.col("_short").alias("other"), "edits").unionByName(edits.select(F.col("_short").alias("id"), F.col("_long").alias("other"), "edits"))
    return both.distinct()
