"""Exact nearest neighbours, per-group neighbours, re-ranking and the merging of ranked results.

Position is data: every result carries its rank; ties are broken by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranking import global_rank


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def query_vector(df: DataFrame, key: str, value, vector: str = "embedding") -> Column:
    """One vector as a literal, so that scoring needs no join."""
    row = df.where(F.col(key) == value).select(vector).first()
    return F.array(*[F.lit(float(x)) for x in row[0]])


def with_distance(df: DataFrame, query: Column, vector: str = "embedding") -> DataFrame:
    return df.withColumn("distance", F.round(cosine_distance(F.col(vector), query), 6)).drop(vector)


def knn(df: DataFrame, query: Column, k: int, key: str, condition: Column | None = None) -> DataFrame:
    """The k nearest rows, filtered first (a TakeOrdered, no full sort)."""
    rows = df if condition is None else df.where(condition)
    top = with_distance(rows, query).orderBy("distance", key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))


def knn_per_group(df: DataFrame, query: Column, k: int, key: str, group: str) -> DataFrame:
    """The k nearest rows of each group with the same vector (the window becomes a group limit before the shuffle)."""
    w = Window.partitionBy(group).orderBy("distance", key)
    return with_distance(df, query).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distances_to_set(rows: DataFrame, queries: DataFrame, key: str, vector: str = "embedding", blocks: tuple[int, int] = (4, 4)) -> DataFrame:
    """(query_id, columns of rows, distance) of every row to every query, joined block against block: neither side is broadcast.

    A query goes to all blocks of rows and a row to all blocks of queries, so that each pair meets once.
    """
    def side(df: DataFrame, own: str, other: str, n: int, others: int, name: str) -> DataFrame:
        scaled = df.withColumn(f"_norm_{name}", norm(F.col(vector))).withColumnRenamed(vector, f"_{name}")
        return scaled.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    q = side(queries.select(key, vector), "_qb", "_rb", blocks[0], blocks[1], "q").withColumnRenamed(key, "query_id")
    r = side(rows, "_rb", "_qb", blocks[1], blocks[0], "r")
    distance = F.round(F.lit(1.0) - dot(F.col("_r"), F.col("_q")) / (F.col("_norm_r") * F.col("_norm_q")), 6)
    return r.join(q, ["_qb", "_rb"]).withColumn("distance", distance).select("query_id", *[c for c in rows.columns if c != vector], "distance")


def knn_set(rows: DataFrame, queries: DataFrame, k: int, key: str, group: str | None = None) -> DataFrame:
    """The k nearest rows of each query, or of each query and group."""
    w = Window.partitionBy("query_id", *[group] * bool(group)).orderBy("distance", key)
    return distances_to_set(rows, queries, key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def interleave(df: DataFrame, group: str, key: str, rank: str = "rank", per_group: int | None = None) -> DataFrame:
    """Best of each group, then second of each: position over (rank in group, group).

    Results that hold at most per_group rows of each group are short and numbered by one window; any others side by side.
    """
    if per_group is not None:
        return df.where(F.col(rank) <= per_group).withColumn("position", F.row_number().over(Window.orderBy(rank, group, key)))
    return global_rank(df, [F.col(rank), F.col(group), F.col(key)], "position")


def rerank(df: DataFrame, score: Column, alpha: float, group: str | None, key: str) -> DataFrame:
    """Blend of similarity and score, larger first; equal blends keep the vector order."""
    combined = F.round((1 - alpha) * F.greatest(F.lit(0.0), 1 - F.col("distance")) + alpha * score, 6)
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc("combined"), F.col("rank"), F.col(key))
    return df.withColumn("combined", combined).withColumn("new_rank", F.row_number().over(w))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in order (not any, as dropDuplicates would)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
