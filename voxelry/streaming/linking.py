"""Labels that run on over chunks of time, for chunks that arrive one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import DIMS
from ..operators.graph import components, consecutive
from ..storage import Scratch, exists, shuffled

#: A label's number over all chunks: the chunk's number, and the label in the low bits.
BITS = 40


class ChunkLinks:
    """What is known of the chunks so far, as tables in a folder that the cluster shares. Chunks have numbers from 0 and come in their order.

    labels: (label, root) of each chunk, as it came; merges: roots of earlier chunks that a chunk has joined to a smaller one;
    border: its last step's voxels with their roots. A chunk is joined with the border before it alone, so its cost doesn't grow with what came
    before. It counts once its commit, written last, is there; given again, it is left as it is, and after a failure it is written anew.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, table: str, chunk: int) -> str:
        return f"{self.folder}/{table}/chunk={chunk}"

    def _write(self, df: DataFrame, table: str, chunk: int) -> None:
        df.write.mode("overwrite").parquet(self._at(table, chunk))

    def add(self, chunk: int, voxels: DataFrame) -> DataFrame:
        """(old, new): roots that this chunk (t, z, y, x, label) joins to smaller ones; all other labels keep theirs.

        Labels are from 1 within the chunk; voxels without one are background, repeated ones count once. Chunks without voxels, or with a gap in
        time before them, join nothing. ValueError if the chunk before isn't there.
        """
        spark = self.spark
        if not exists(spark, self._at("commits", chunk)):
            if chunk and not exists(spark, self._at("commits", chunk - 1)):
                raise ValueError(f"chunk {chunk - 1} comes before chunk {chunk}")
            scratch = Scratch(spark)
            mine = voxels.where("label > 0").select(*(F.col(d).cast("long").alias(d) for d in DIMS), (F.lit(chunk << BITS) + F.col("label").cast("long")).alias("label"))
            mine = shuffled(scratch.save(mine))  # read several times
            first, last = mine.agg(F.min("t"), F.max("t")).first()
            if chunk and first is not None:
                before = shuffled(spark.read.parquet(self._at("border", chunk - 1))).where(F.col("t") == first - 1)
                head = mine.where(F.col("t") == first).select("z", "y", "x", F.col("label").alias("dst"))
                links = before.select("z", "y", "x", F.col("root").alias("src")).join(head, ["z", "y", "x"]).select("src", "dst").distinct()
                found = shuffled(scratch.save(components(links, scratch)))
            else:
                found = spark.createDataFrame([], "node long, component long")
            roots = mine.select("label").distinct().join(found, F.col("label") == F.col("node"), "left").select("label", F.coalesce("component", "label").alias("root"))
            self._write(roots, "labels", chunk)
            self._write(found.where((F.col("node") < chunk << BITS) & (F.col("node") != F.col("component"))).select(F.col("node").alias("old"), F.col("component").alias("new")), "merges", chunk)
            roots = shuffled(spark.read.schema("label long, root long").parquet(self._at("labels", chunk)))
            border = mine.where(F.col("t") == F.lit(last)).join(roots, "label").select("t", "z", "y", "x", "root")
            self._write(border, "border", chunk)
            self._write(spark.range(1), "commits", chunk)
        return spark.read.schema("old long, new long").parquet(self._at("merges", chunk))

    def links(self, scratch: Scratch) -> DataFrame:
        """(chunk, old, new) of all labels: as link_chunks() numbers them, from 1 in the order of each group's first label."""
        read = lambda t, s: shuffled(self.spark.read.schema(s).parquet(f"{self.folder}/{t}/*"))
        merged = components(read("merges", "old long, new long").select(F.col("old").alias("src"), F.col("new").alias("dst")), scratch)
        labels = read("labels", "label long, root long").join(merged, F.col("root") == F.col("node"), "left").select("label", F.coalesce("component", "root").alias("root"))
        labels = shuffled(scratch.save(labels))
        ranks = consecutive(labels, "root", scratch, "new")
        low = F.lit((1 << BITS) - 1)
        return labels.join(ranks, "root").select(F.shiftright("label", BITS).cast("int").alias("chunk"), F.col("label").bitwiseAND(low).alias("old"), "new")

    def follow(self, stream: DataFrame, checkpoint: str, chunk: str = "chunk") -> StreamingQuery:
        """A running query that adds each chunk of a stream of voxels; a batch holds whole chunks (a file each, say). A batch that comes again changes nothing."""

        def batch(df: DataFrame, _: int) -> None:
            for (n,) in df.select(chunk).distinct().orderBy(chunk).collect():  # the batch's few chunk numbers
                self.add(n, df.where(F.col(chunk) == n))

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
