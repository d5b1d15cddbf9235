"""Operator 3: URL rules by hashed host-suffix and path-prefix expressions, on built-in functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..storage import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many bytes (estimated) go to every executor; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule and verdict of every row of pages.

    rules: (verdict, host, path). A rule fits its host and the host's subdomains if the path starts
    with the rule's path. The longest rule (host and path together) wins; among equally long ones
    the longer host, then block. Without a rule: null and `default`. Each row gives one row: null
    keys and URLs, repeated rows and repeated keys included; other columns are not read.

    Every URL is expanded into host suffixes (only of as many labels as some rule has) times path
    prefixes (only of lengths that some rule has); they meet the rules on 32 bits of a digest, and
    the whole digest confirms. Pages that share host and path are judged once; those of a host and
    path that many pages have (all without a URL, say) take their verdict without being shuffled.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(v, h.lower(), p) for v, h, p in rules], "verdict string, rule_host string, rule_path string").dropDuplicates()
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    table = table.select(
        F.substring(digest, 1, 8).alias("short"), digest.alias("digest"),
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"),
            F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict"),
        ).alias("hit"),
    )
    host, path = host_and_path(F.col(url))
    # URLs of the same host and path are judged once, and counted
    seen = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    scratch = Scratch(spark)
    distinct = scratch.save(seen.groupBy("host", "path").agg(F.count("*").alias("n")))
    parts = F.split("host", r"\.", -1)
    suffix = [F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, -n, n))) for n in labels]
    prefix = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    asked = (
        distinct.withColumn("suffix", F.explode(F.array_compact(F.array(*suffix)))).withColumn("prefix", F.explode(F.array_compact(F.array(*prefix))))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, 8))
        .select("host", "path", "short", F.col("digest").alias("asked"))
    ) if labels else distinct.limit(0).select("host", "path", F.lit("").alias("short"), F.lit("").alias("asked"))
    small = sum(len(h) + len(p) + 200 for _, h, p in rules) <= BROADCAST_BYTES
    met = asked.join(F.broadcast(table) if small else table, "short").where(F.col("asked") == F.col("digest"))
    best = scratch.save(met.groupBy("host", "path").agg(F.max("hit").alias("hit")))
    return lookup(seen, best, ["host", "path"], distinct, "left").select(
        F.col("key").alias(key), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.lit(default)).alias("verdict")
    )
