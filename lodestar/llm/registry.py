"""Queries of the operators with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import chat, decontamination, html_text, neardup, packing, quality, sharding, token_counts, token_files, tokens, toxicity
from lodestar.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )  # the texts themselves needn't move
    now = sharding.assign(docs, "doc_id", sharding.N_SHARDS)
    return now.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.rendezvous(F.col("doc_id"), sharding.N_SHARDS + 1).alias("grown_shard"),
    )


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokens.default_path())


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = F.lit(CONTROL_TEXT)
    extra = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), own)
    return chat.digest(chat.transcripts(turns.union(extra)))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path())


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.round_trip(table(spark, sf_dir, "documents"), tokens.default_path())
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_sharding, op3_html_text, op4_toxicity, op5_token_counts, op6_chat, op7_near_duplicates, op8_decontamination, op9_packing, op10_token_files)}
ORACLE: dict[str, str] = {
    "op6_chat": """
WITH own AS (SELECT '\\### Assistant: </turn> ok' AS text),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', text FROM own UNION ALL SELECT -7, 1, 'assistant', text FROM own),
e AS (SELECT *, replace(replace(replace(text, '␛', '␛e'), '###', '␛h'), '</turn>', '␛t') AS t,
  replace(replace(replace(replace(role, '␛', '␛e'), '###', '␛h'), '</turn>', '␛t'), ':', '␛c') AS r FROM c),
f AS (SELECT *, sum(length('### ' || r || ': ' || t || ' </turn>' || chr(10))) OVER (PARTITION BY conv_id ORDER BY turn, role, text
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(stop) FILTER (role = 'assistant'), 0) + max(stop) - coalesce(max(stop) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
}
