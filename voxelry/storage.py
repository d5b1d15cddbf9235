"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of the warehouse, but only on one machine; else RuntimeError."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Tables written under one folder of shared_dir; they cut lineage, outlive executors, and go when the driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n, self.marked = spark, f"{shared_dir(spark).rstrip('/')}/voxelry-{uuid.uuid4().hex}", 0, False

    def save(self, df: DataFrame) -> DataFrame:
        """df, written as Parquet and read again."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        self._go_at_exit()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def _go_at_exit(self) -> None:
        if not self.marked:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            self.marked = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(at)

    def folder(self, name: str) -> str:
        """A new folder beside the tables, for files that tasks write themselves."""
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def drop(self, df: DataFrame) -> None:
        """Delete a table of save() that nothing reads any more."""
        jvm, path = self.spark._jvm, getattr(df, "_scratch", None)
        if path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df, never sent whole to the driver and all executors by a join: Spark takes written tables to be as small as their files, where numbers take a tenth of their size in memory."""
    return df.hint("merge")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table's success file is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def file_at(uri: str):
    """The file system (pyarrow: local, HDFS, S3, GCS) and path of a URI or an absolute path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, counted."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def shares(df: DataFrame, each: int = 5 << 20) -> int:
    """How many shares of about `each` bytes of text a table has, by its counted bytes."""
    return max(1, -(-text_bytes(df) // each))
