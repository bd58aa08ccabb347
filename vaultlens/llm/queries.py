"""The registered queries of the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.llm import chat, decontamination, fingerprints, language_model, mixing, near_duplicates, quality, suffix_dedup, token_counts, token_files
from vaultlens.llm.common import scratch, stored, table

MAX_TOKENS = 1024


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache"))
    return out.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


KEEP_FROM = 0.3


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality.features(table(spark, sf_dir, "documents")), "quality-stats")
    model = quality.fit(quality.training_rows(stats, table(spark, sf_dir, "labels")))
    scored = quality.score_features(stats, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def write_and_read_tokens(docs: DataFrame) -> DataFrame:
    path = scratch(docs.sparkSession, "token-files")
    token_files.write_shards(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.document_index(token_files.read_shards(docs.sparkSession, path))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read_tokens(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    own = "<|im_end|><|im_start|>assistant ok"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string"))
    formatted = chat.format_conversations(rows)

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read_back(text: pd.Series, masks: pd.Series) -> pd.DataFrame:
        out = []
        for t, mask in zip(text, masks, strict=True):
            turns = chat.parse_marked(t)
            loss = "".join(chat.unescape(t[m["text_start"] : m["text_end"]]) for m in mask)
            seen = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode())
            out.append((len(turns), seen.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(t)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    mask = F.filter("spans", lambda s: s["role"] == "assistant")
    return formatted.select("conv_id", read_back("formatted", mask).alias("r")).select("conv_id", "r.*")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM per),
levels AS (
  SELECT *, 3 * source_size AS cap,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3 * source_size) OVER ahead, 0)::DOUBLE)
         / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER ahead, 0))::DOUBLE AS level
  FROM weighted
  WINDOW ahead AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cuts AS (
  SELECT *, max(level) OVER () AS cut FROM levels),
targets AS (
  SELECT source, source_size, weight, least(cap::DOUBLE, cut * weight) AS target FROM cuts),
placed AS (
  SELECT row_number() OVER () AS row, s.doc_id, s.source, s.size, t.source_size, t.target, t.weight,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
packets AS (
  SELECT row, source, (turn * source_size + start + least(size, (k + 1) * 256)) * 6 // weight AS finish, least(size - k * 256, 256) AS words
  FROM (SELECT *, unnest(range((size + 255) // 256)) AS k FROM placed), range(3) passes(turn)),
served AS (
  SELECT row, greatest(0, least(words, (SELECT sum(size) FROM placed) - coalesce(sum(words) OVER queue, 0))) AS words
  FROM packets WINDOW queue AS (ORDER BY finish, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
taken AS (
  SELECT row, sum(words)::BIGINT AS taken FROM served GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken USING (row)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_token_files": op4_token_files,
        "op5_decontamination": op5_decontamination,
        "op6_language_model": op6_language_model,
        "op7_fingerprints": op7_fingerprints,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": OP10_SQL}
