"""The thin opN_<name> queries: each applies its operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.llm import chat, decontaminate, jaccard, lm, pieces, quality, secrets, suffixes, surrogates, toxicity
from docspan.operators.runs import spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one in few files is dealt out to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, Jaccard similarity of 0.85 or more."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), 4, Fraction(85, 100)).drop("row_hash", "class_id")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose turns hold the template's own control strings."""
    hostile = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.HOSTILE).alias("text"))
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile)
    return chat.digest(chat.format_chats(conversations))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes."""
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the secret of the session's setting spark.docspan.surrogates.key."""
    return surrogates.summarise(surrogates.replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), surrogates.secret_key(spark)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger under the current policy."""
    ledger = quality.apply_policy(quality.quality_ledger(_table(spark, sf_dir, "documents")))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return ledger.select(*first, "n_lines", "n_letters", "failed", "policy")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy drops, alone and given the others."""
    return quality.ablation(quality.quality_ledger(_table(spark, sf_dir, "documents")))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles; a document that holds 0.8 of an item's is contaminated."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_lm_scores, op3_sentencepiece, op4_chat_formatting, op5_suffix_array_dedup, op6_secret_scan, op7_pii_surrogates, op8_quality_rules, quality_ablation, op9_benchmark_decontamination, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": jaccard.ORACLE, "op4_chat_formatting": chat.ORACLE, "op8_quality_rules": quality.ORACLE, "quality_ablation": quality.ABLATION_ORACLE,
        "op9_benchmark_decontamination": decontaminate.ORACLE,
    }
