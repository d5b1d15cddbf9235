"""Statistics of many systems in batches of bounded work, of which a rerun does only what is missing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Scratch, exists


class Runs:
    """Results of systems in a folder that the cluster shares, a batch after the other.

    A batch's results are written, then its ids; only ids with both count, so a batch that a stop has cut
    short leaves nothing behind that is read, and each system has its results once.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _tables(self, kind: str) -> list[str]:
        """Folders of complete batches: one for each batch so far."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ids")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return [f"{self.folder}/{kind}/{n}" for n in sorted(names) if exists(self.spark, f"{self.folder}/ids/{n}")]

    def finished(self) -> DataFrame:
        """system: those that have their results."""
        found = self._tables("ids")
        return self.spark.read.schema("system long").parquet(*found) if found else self.spark.createDataFrame([], "system long")

    def results(self) -> DataFrame | None:
        """The results of all finished systems; None before the first batch."""
        found = self._tables("results")
        return self.spark.read.parquet(*found) if found else None

    def batches(self, sizes: DataFrame, budget: int, scratch: Scratch) -> DataFrame:
        """(system, batch) of systems (system, n) that aren't finished, packed in the order of their ids into batches of about `budget` rows.

        Rows are summed range by range of ids, so no task sorts all. A system larger than that is a batch with what comes just before it.
        Null systems are left out, repeated ones add up.
        """
        open_ = sizes.where("system IS NOT NULL").groupBy(F.col("system").cast("long").alias("system")).agg(F.sum("n").cast("long").alias("n")).join(self.finished(), "system", "left_anti")
        spread = scratch.save(open_.repartitionByRange("system").withColumn("part", F.spark_partition_id()))
        before = spread.groupBy("part").agg(F.sum("n").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("low"))  # a row a range
        inside = F.sum("n").over(Window.partitionBy("part").orderBy("system")) - F.col("n")
        return scratch.save(spread.withColumn("at", inside).join(before, "part").select("system", F.floor((F.col("at") + F.col("low")) / budget).alias("batch")))

    def run(self, sizes: DataFrame, compute: Callable[[DataFrame], DataFrame], budget: int, most: int | None = None) -> int:
        """Computes what is missing, `most` batches at most, and says how many it did.

        compute: gets the ids (system) of a batch and gives their results, a table with a column system. Systems without results are finished too.
        """
        scratch = Scratch(self.spark)
        batches = self.batches(sizes, budget, scratch)
        numbers = [r[0] for r in batches.select("batch").distinct().orderBy("batch").limit(most if most is not None else 1 << 30).collect()]  # one for each batch
        for n in numbers:
            ids, name = batches.where(F.col("batch") == n).select("system"), uuid.uuid4().hex
            compute(ids).write.option("compression", "zstd").parquet(f"{self.folder}/results/{name}")
            ids.write.parquet(f"{self.folder}/ids/{name}")
        return len(numbers)
