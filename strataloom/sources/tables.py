"""Readers, and the folder for written cut points."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_path, content, sha256, size, modified) of whole files under ``path``; bytes that are no UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines under a declared schema; lines that do not fit it are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_rows(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV rows under a declared schema (nothing is inferred)."""
    return spark.read.schema(schema).option("header", header).csv(path)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where it is unset (tests)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints/strataloom").rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, a lost executor costs no recomputation."""
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Cuts:
    """Written cut points of one operator, removed together once what was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        """As ``written``, but kept in mind for ``clear``."""
        self.paths.append(f"{scratch(self.spark)}/{tag}-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        """Removes the files, through Spark's own file systems."""
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def versions(df: DataFrame) -> tuple:
    """The files behind ``df`` with their sizes and times: another tuple once one is written anew."""
    files = df.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("double").alias("at")).distinct()
    return tuple(sorted(tuple(r) for r in files.collect()))
