"""Cutting lineage for iterative plans, and rows dealt by ranges once for several uses."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine.
FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).  A local session without one
    uses FALLBACK; on a cluster that folder would not be shared, so ValueError."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = FALLBACK
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def cut(df: DataFrame, what: str = "stage") -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends, later
    reads prune columns, and a lost executor loses nothing.  The files go when the
    session ends, or before by drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Deletes the files of frames that cut() gave and nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_stage_path", None):
            fs, where = _file_system(df.sparkSession, path)
            fs.delete(where, True)


class Appended:
    """A table in the shared folder that grows: every add() is one commit, earlier rows are
    not written again."""

    def __init__(self, first: DataFrame, what: str):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path = f"{shared_dir(self.spark)}/{what}-{uuid.uuid4().hex}"
        fs, where = _file_system(self.spark, self.path)
        fs.deleteOnExit(where)
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        rows.select(*self.schema.names).write.mode("append").parquet(self.path)
        return self.read()

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def dealt(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """df in ranges of the order, _part their number, written once: ranges are sampled
    anew whenever a plan runs, so uses of several plans must share one run's rows."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "dealt")
