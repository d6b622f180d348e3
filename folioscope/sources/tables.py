"""Parquet tables by name, and the removal of re-delivered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one table; with columns, only these reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def first_delivery(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """One row per key, the earliest delivered (a hash aggregate, no sort of whole rows across the cluster).

    Null keys form one group. Ties on the order column are broken by the smallest row.
    """
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(F.coalesce(F.col(order).cast("string"), F.lit("~")))) if order in df.columns else F.first(F.struct(*rest))
    return df.groupBy(key).agg(first.alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in rest])
