"""Files that are named by the times they hold, as a table of spans; which of them a span of time needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Two times in a file's name, fixed by the naming scheme.
TIMES = r"(\d{8}T\d{4}).*?(\d{8}T\d{4})"
#: Days that one bin of the join spans.
BIN = 1


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files of a folder and those below it; Spark lists them, and no file is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")


def spans(files: DataFrame) -> DataFrame:
    """The files (path) with start and stop, the two times in their names; those without two are left out, and so are repeated rows. No rows: none."""
    name = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    time = lambda i: F.try_to_timestamp(F.regexp_extract(name, TIMES, i), F.lit("yyyyMMdd'T'HHmm")).cast("timestamp_ntz")
    return files.withColumn("start", time(1)).withColumn("stop", time(2)).where("start IS NOT NULL AND stop IS NOT NULL").distinct()


def _days(start: Column, stop: Column) -> Column:
    day = lambda c: F.floor(F.unix_date(F.to_date(c)) / BIN)
    return F.explode(F.sequence(day(start), day(stop)))


def needed(index: DataFrame, asked: DataFrame, closed: bool = True) -> DataFrame:
    """The rows of asked (start, stop and others) with the path of each file of the index (path, start, stop) whose times meet theirs.

    closed: both ends count, else a span ends before its stop. Files and spans meet by the days they have, in the first day that both have; spans whose
    stop lies before their start meet nothing. Rows of asked without a file are left out. No list of files is on the driver.
    """
    files = index.where("start <= stop").select("path", F.col("start").alias("_a"), F.col("stop").alias("_b"), _days(F.col("start"), F.col("stop")).alias("_day"))
    spans_ = asked.where("start <= stop").withColumn("_day", _days(F.col("start"), F.col("stop")))
    meets = "_a <= stop AND start <= _b" if closed else "_a < stop AND start < _b"
    once = F.col("_day") == F.floor(F.unix_date(F.to_date(F.greatest("_a", "start"))) / BIN)
    return spans_.join(files, "_day").where(meets).where(once).drop("_day", "_a", "_b")


def counted(index: DataFrame, asked: DataFrame, closed: bool = True) -> DataFrame:
    """The rows of asked (start, stop and others) with `files`, how many rows of needed() they have, and `first`, the smallest path; those without a file are left out.

    No pair of a span and a file is written out. On each day that they have, files of the same times within that day stand as one row with their number, and
    so do spans of the same times. The rows that meet are bounded by the different times of a day, to the minute in names of files, not by the files.
    """
    day = lambda c: F.floor(F.unix_date(F.to_date(c)) / BIN)
    midnight = lambda n: F.date_from_unix_date(((F.col("_day") + n) * BIN).cast("int")).cast("timestamp_ntz")
    before = F.when(F.col("_a") < midnight(0), midnight(-1)).otherwise(F.col("_a"))
    files = index.where("start <= stop").select("path", F.col("start").alias("_a"), F.col("stop").alias("_b"), _days(F.col("start"), F.col("stop")).alias("_day"))
    files = files.groupBy("_day", before.alias("_a"), F.least("_b", midnight(1)).alias("_b")).agg(F.count("*").alias("_n"), F.min("path").alias("_path"))
    times = asked.where("start <= stop").select("start", "stop").distinct()
    meets = "_a <= stop AND start <= _b" if closed else "_a < stop AND start < _b"
    met = times.withColumn("_day", _days(F.col("start"), F.col("stop"))).join(files, "_day").where(meets).where((F.col("_day") == day(F.col("_a"))) | (F.col("_day") == day(F.col("start"))))
    found = met.groupBy("start", "stop").agg(F.sum("_n").alias("files"), F.min("_path").alias("first"))
    return asked.join(found, ["start", "stop"])


def gaps(index: DataFrame) -> DataFrame:
    """Files (path, start, stop) after which no other begins just where they end, though later ones follow: where a chain of files breaks."""
    following = index.select(F.col("start").alias("stop")).distinct()
    last = index.agg(F.max("stop").alias("last"))  # one row
    return index.join(following, "stop", "left_anti").join(F.broadcast(last), F.col("stop") < F.col("last")).select("path", "start", "stop")
