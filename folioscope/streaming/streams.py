"""Streams: extensions of the batch operators, which define no event-time semantics of their own.

Window counts close ten minutes after the last event time seen; later events are dropped by the watermark. The
incremental index merges each micro-batch by fingerprint and can be run again without change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def read_parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_to_table(df: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now, its result written to a shared folder by each micro-batch, and read that."""
    path = f"{folder}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/result")


def merge(current: DataFrame, batch: DataFrame, key: str, hash_column: str) -> DataFrame:
    """The current rows with those of a batch put in: new keys and changed fingerprints replace, equal ones stay."""
    fresh = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col(hash_column)).alias("_row")).select("_row.*")
    kept = current.join(fresh.select(key, F.col(hash_column).alias("_new")), key, "left").where(F.col("_new").isNull() | (F.col("_new") == F.col(hash_column))).drop("_new")
    changed = fresh.join(current.select(key, F.col(hash_column).alias("_old")), key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col(hash_column))).drop("_old")
    return kept.unionByName(changed)
