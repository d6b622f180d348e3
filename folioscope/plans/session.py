"""Session helpers: where shared state is written and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("folioscope")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a session whose executors are threads of the driver (master local) may go without one and gets a folder of its
    own; on a cluster each executor would write to its own disk, so that is an error.
    """
    context = spark.sparkContext
    set_dir = context._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="folioscope-checkpoint-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no recomputation of earlier steps."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of an iteration, written below the shared folder and deleted when the iteration is over.

    A checkpoint carries the constraints of the plan that it replaces; over rounds of self-joins they double each time,
    until planning takes minutes. A table read again has none, and its size on disk tells the planner what to broadcast.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.count = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.at}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
