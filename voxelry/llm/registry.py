"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import digests

    return digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), size=3, percent=85)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_read(spark, sf_dir, "pages"), RULES)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score

    return score(_read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import digests

    return digests(_read(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dac import read, write

    return read(write(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_trie import rebuilt_trie

    return rebuilt_trie(_read(spark, sf_dir, "conversations"))


_OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""


_OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS seq FROM t GROUP BY conv_id
), crc AS (
  SELECT conv_id, seq, conv_id - conv_id % 5 AS base,
    CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) // 2, (xor(a, b) % 2) * 3988292384)), 4294967295) % 9 AS INT) AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.seq, []), 1, c.h), list_slice(c.seq, c.h + 1, len(c.seq))) AS seq FROM crc c LEFT JOIN own b ON b.conv_id = c.base
), prefixes AS (
  SELECT conv_id, d, list_slice(seq, 1, d) AS path, len(seq) AS n FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(octet_length(encode(path[-1].text)), 0) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM prefixes GROUP BY d, path
), named AS (
  SELECT p.conv_id AS member, p.d, o.conv_id FROM prefixes p JOIN nodes o ON o.d = p.d AND o.path = p.path
), ups AS (
  SELECT o.*, u.conv_id AS parent_conv_id FROM nodes o LEFT JOIN named u ON u.member = o.conv_id AND u.d = o.d - 1
), kids AS (
  SELECT parent_conv_id, d - 1 AS d, count(*) AS n_children FROM ups WHERE d > 0 GROUP BY ALL
), told AS (
  SELECT o.*, coalesce(k.n_children, 0) AS n_children FROM ups o LEFT JOIN kids k ON k.parent_conv_id = o.conv_id AND k.d = o.d
), sums AS (
  SELECT a.conv_id, a.d, CAST(sum((o.n_children = 0)::INT) AS BIGINT) AS n_leaves, CAST(sum(o.own) AS BIGINT) AS saved_tokens FROM told o JOIN named a ON a.member = o.conv_id AND a.d <= o.d GROUP BY a.conv_id, a.d
)
SELECT o.conv_id, o.d AS depth, o.parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256 FROM told o JOIN sums s ON s.conv_id = o.conv_id AND s.d = o.d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_minhash, op3_url_filters, op4_katz, op5_packing, op6_token_counts, op7_substring_dedup, op8_embedding_dedup, op9_quality_rules, op10_token_files, op11_alignment, op12_nearest, op13_turn_trie, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": _OP3_SQL, "op13_turn_trie": _OP13_SQL}
