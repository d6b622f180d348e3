"""A rank over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.plans.session import cut


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Number all rows from 1 in order: range partitions are sorted side by side, and each starts after the rows before it.

    The order must be total for a repeatable rank. Only one count per partition is gathered.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    # One row per partition, whatever the data.
    return numbered.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_in") + 1)).drop("_part", "_in", "_before")
