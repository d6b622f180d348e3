"""Vocabulary labels in texts: the n-gram join, expansion of questions, term scores and the glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def labels_of(thesaurus: DataFrame) -> DataFrame:
    """(uri, label, words, n): labels of at least five characters, or in capitals; the first entry by uri keeps a shared label."""
    every = thesaurus.select("uri", F.explode(F.concat(F.array("pref_label"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("label"))
    fit = every.where((F.length("label") >= 5) | F.col("label").rlike("^[A-Z]{2,6}$")).withColumn("key", F.array_join(normal_words(F.col("label")), " "))
    first = F.row_number().over(Window.partitionBy("key").orderBy("uri", "label"))
    return fit.withColumn("_n", first).where("_n = 1 and key <> ''").select("uri", "label", "key", (F.size(F.split("key", " "))).alias("n"))


def places(texts: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """(key, uri, label, at, n): where the words of a label stand in a text (at: the first word, from 1; n: words).

    Each word of a text, with as many after it as the longest label has, meets the labels that begin with it. A label in
    capitals is only found in capitals.
    """
    longest = labels.agg(F.max("n")).first()[0] or 0
    words = texts.select(key, F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    ahead = F.transform("w", lambda _, i: F.slice("w", i + 1, longest)) if longest else F.array().cast("array<array<string>>")
    at = words.select(key, F.posexplode(ahead).alias("at", "ahead")).withColumn("at", F.col("at") + 1).withColumn("_first", F.lower(F.get("ahead", F.lit(0))))
    starts = labels.select("uri", "label", F.col("key").alias("_key"), "n", F.split("key", " ")[0].alias("_first"), F.col("label").rlike("^[A-Z]{2,6}$").alias("_code"))
    met = at.join(starts, "_first")
    same = F.lower(F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ")) == F.col("_key")
    return met.where(same & (~F.col("_code") | (F.get("ahead", F.lit(0)) == F.col("label")))).select(key, "uri", "label", "at", "n")


def longest_places(found: DataFrame, key: str) -> DataFrame:
    """places() without those inside a longer one."""
    before = Window.partitionBy(key).orderBy("at", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("n")
    return found.withColumn("_end", F.max(end).over(before)).where(F.col("_end").isNull() | (end > F.col("_end"))).drop("_end")


def mentions(texts: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """(key, uri, label): labels whose words stand in a text one after another; per concept the longest, then the first."""
    best = F.max_by("label", F.struct(F.length("label"), F.transform(F.split("label", ""), lambda c: -F.ascii(c))))
    return places(texts, key, labels).groupBy(key, "uri").agg(best.alias("label"))


def document_frequency(hits: DataFrame, key: str) -> DataFrame:
    return hits.groupBy("uri").agg(F.count_distinct(key).alias("n_texts"))


def term_score(hits: DataFrame, key: str) -> DataFrame:
    """Distinct concepts of a text, at most four count, as a share."""
    return hits.groupBy(key).agg((F.least(F.count_distinct("uri"), F.lit(4)) / 4.0).alias("score"))


def expand(hits: DataFrame, thesaurus: DataFrame, key: str, limit: int = 6) -> DataFrame:
    """(key, terms): preferred labels and two alternatives of the concepts mentioned, in order of concept, at most `limit`."""
    terms = thesaurus.select("uri", F.slice(F.concat(F.array("pref_label"), F.slice(F.coalesce("alt_labels", F.array().cast("array<string>")), 1, 2)), 1, 3).alias("t"))
    joined = hits.join(terms, "uri").select(key, "uri", F.posexplode("t").alias("i", "term"))
    w = Window.partitionBy(key).orderBy("uri", "i")
    return joined.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select(key, "n", "term")
