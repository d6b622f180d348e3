"""Folders of text files as rows, one per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(source_file, content): every file below path whose name fits, whole; source_file is its path below path.

    A byte order mark at the beginning is no content.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1)
    return files.select(F.url_decode(name).alias("source_file"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("content"))


def write_files(files: DataFrame, path: str) -> None:
    """Each row (source_file, content) as one file in a folder of its name."""
    files.select("content", F.col("source_file").alias("file")).repartition("file").write.partitionBy("file").option("lineSep", "\n").text(path)
