"""The registered queries of this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.session import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.quality import judge

    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from murmurate.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.substrings import remove

    return remove(table(spark, sf_dir, "documents")).drop("kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.secrets import digests

    return digests(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: One more conversation whose texts hold control strings.
TRICKY = r"\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmurate.llm.chat import digests

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return digests(turns.unionByName(extra)).drop("valid")


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT CAST(-7 AS BIGINT), CAST(i AS BIGINT), CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)
), s AS (
  SELECT *, regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g') AS escaped FROM t
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length('<turn ' || role || '>' || chr(10)) + length(escaped) + length('</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lm_score": op2_lm_score,
    "op3_near_dups": op3_near_dups,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_pack": op6_pack,
    "op7_html": op7_html,
    "op8_substrings": op8_substrings,
    "op9_secrets": op9_secrets,
    "op10_chat": op10_chat,
    "op11_simhash": op11_simhash,
    "op12_whitening": op12_whitening,
    "op13_importance": op13_importance,
}
ORACLES: dict[str, str] = {"op10_chat": OP10_SQL}
