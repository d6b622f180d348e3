"""A table kept in versions: each change writes the next version beside the last, and only then is it the current one.

A reader sees one whole version; a change that is cut off leaves the last version current and can be made again.
Merging the same batch twice leaves the same rows. Columns: a key, a fingerprint of the content, others as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.streaming.streams import merge


class Store:
    def __init__(self, spark: SparkSession, path: str, key: str, content: str = "hash"):
        self.spark, self.path, self.key, self.content = spark, path, key, content
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, the current one last."""
        if not self._fs.exists(self._jpath(self.path)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._jpath(self.path))]
        return sorted(int(n[1:]) for n in found if n.startswith("v") and self._fs.exists(self._jpath(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.versions()[-1]}")

    def write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{(self.versions() or [0])[-1] + 1}")

    def upsert(self, batch: DataFrame) -> None:
        """New keys are added and changed fingerprints replaced; the first batch makes the table."""
        self.write(merge(self.read(), batch, self.key, self.content) if self.versions() else batch.dropDuplicates([self.key]))

    def delete_stale(self, present: DataFrame) -> None:
        """Rows whose key the sources no longer have are left out."""
        self.write(self.read().join(present.select(self.key).distinct(), self.key, "left_semi"))

    def retag(self, tags: DataFrame) -> None:
        """Columns of tags replace those of the rows with their key; content and fingerprint stay."""
        names = [c for c in tags.columns if c != self.key]
        new = tags.select(self.key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in names])
        rows = self.read().join(new, self.key, "left")
        self.write(rows.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in names}).drop("_new", *[f"_{c}" for c in names]))

    def drop(self) -> None:
        self._fs.delete(self._jpath(self.path), True)

    def prune(self, keep: int = 1) -> None:
        """Older versions than the last `keep` are deleted, when no reader uses them any more."""
        for v in self.versions()[:-keep]:
            self._fs.delete(self._jpath(f"{self.path}/v{v}"), True)
