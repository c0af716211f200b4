"""One registered query per operator, over the whole ``documents`` or
``conversations`` table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import documents
from ledgerlens.llm.conversations import damaged, repair_conversations
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.language_id import language_id
from ledgerlens.llm.licenses import license_scan
from ledgerlens.llm.line_dedup import line_dedup
from ledgerlens.llm.maxent import maxent_scores
from ledgerlens.llm.minhash import near_duplicates
from ledgerlens.llm.mixing import mix_documents
from ledgerlens.llm.packing import pack_documents
from ledgerlens.llm.periodic import periodic_runs
from ledgerlens.llm.quality import BASE, quality_rules
from ledgerlens.llm.sharding import shard_documents
from ledgerlens.llm.token_file import read_token_file, write_token_file
from ledgerlens.plans.session import scratch_path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "proven")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", *BASE, "base_failed", "kept", "posterior")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.col("_ll_lines").alias("n_lines"), F.col("_ll_removed").alias("n_removed"),
                        F.length("text").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("d1", "d2")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "llm-token-file")
    write_token_file(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_file(spark, path, with_ids=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir), best=True)


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), digest_all=True)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")))


def op12_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_scores(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(documents(spark, sf_dir), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_best_fit_packing, op2_quality_rules, op3_line_dedup, op4_minhash_near_dedup, op5_token_file,
        op6_language_id, op7_source_mix, op8_license_scan, op9_hilbert_shards, op10_exact_dedup,
        op11_conversation_repair, op12_maxent_scores, op13_periodic_runs)}

# Queries not listed here are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
places AS (
  SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM lines WHERE len(l) >= 3),
windows AS (
  SELECT doc_id, p, l[p] AS a, l[p + 1] AS b, l[p + 2] AS c FROM places
  WHERE trim(l[p]) <> '' OR trim(l[p + 1]) <> '' OR trim(l[p + 2]) <> ''),
later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT DISTINCT doc_id, p + k AS p FROM later, (VALUES (0), (1), (2)) AS ks(k)),
each_line AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS line FROM lines),
kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.p) AS text, count(*) AS n
  FROM each_line e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(len(x.l), 0)::INT AS n_lines, (coalesce(len(x.l), 0) - coalesce(k.n, 0))::INT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(k.text, ''))::INT END AS chars_left,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
FROM documents d LEFT JOIN lines x ON d.doc_id = x.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op7_source_mix": r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(text, '')) AS text_md5 FROM documents),
keyed AS (
  SELECT *, ('0x' || substr(md5(concat('17:', coalesce(doc_id::VARCHAR, '-'), ':', text_md5)), 1, 15))::BIGINT AS rnd FROM rows),
caps AS (
  SELECT *, 3 * source_size AS cap FROM (
    SELECT source, sum(size)::BIGINT AS source_size,
      ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight,
      row_number() OVER (ORDER BY source NULLS LAST) AS nth
    FROM rows GROUP BY source)),
levels AS (
  SELECT *, row_number() OVER filling AS place,
    (sum(source_size) OVER ()::BIGINT - coalesce(sum(cap) OVER before, 0)::BIGINT)
      / (sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT)::DOUBLE AS level
  FROM caps WINDOW filling AS (ORDER BY cap / weight, nth),
    before AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opening AS (
  SELECT *, min(CASE WHEN level * weight <= cap THEN place END) OVER () AS opens FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN place < opens THEN cap::DOUBLE
    ELSE least(cap::DOUBLE, max(CASE WHEN place = opens THEN level END) OVER () * weight) END AS target FROM opening),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT k.*, b.source_size, b.target, b.epochs, round(b.target - b.epochs * b.source_size)::BIGINT AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.rnd, k.doc_id, k.text_md5
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(size, greatest(rest - begin, 0)))::BIGINT AS taken FROM placed""",
    "op10_exact_dedup": r"""
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)""",
}
