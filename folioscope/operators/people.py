"""People named by several sources, brought to one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T


def surname(name):
    """The longest word of a printed name, folded: initials, particles and titles are shorter."""
    words = F.filter(F.split(T.fold(name), r"[^\p{L}]+"), lambda w: w != "")
    return F.get(F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(0))


def reconciled(sources: list[DataFrame], fields: list[str]) -> DataFrame:
    """(key, fields, n_sources, disagree) of sources (key, fields), which come in order of precedence.

    A field is that of the first source that has it; disagree lists the fields for which two sources have different
    values. Null keys are left out; a source with several values of a field for one key gives its least.
    """
    def ranked(at: int, df: DataFrame) -> DataFrame:
        return df.where("key is not null").groupBy("key").agg(*[F.min(f).alias(f) for f in fields]).withColumn("_at", F.lit(at))

    rows = reduce(DataFrame.unionByName, [ranked(i, s) for i, s in enumerate(sources)])
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_at"))).alias(f) for f in fields]
    differ = F.filter(F.array(*[F.when(F.count_distinct(f) > 1, F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return rows.groupBy("key").agg(*first, F.count_distinct("_at").alias("n_sources"), F.array_join(differ, ",").alias("disagree"))
