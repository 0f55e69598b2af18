"""The operators of this subpackage over the given tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalume.llm import chat, decontam, html_text, langid, lm, merkle, minhash, mixing, packing, periodic, quality, sharding, tokens
from catalume.llm.oracle import SQL

#: Tokenizer files; a parameter, and no file is copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicate_report(_read(spark, sf_dir, "documents"), 0.85)


def op2_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_report(_read(spark, sf_dir, "conversations"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_manifest(_read(spark, sf_dir, "documents"), 8)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlap_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_read(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"), tokens.read_vocabulary(VOCABULARY))


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_read(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packing_report(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_minhash_dedup, op2_chat_preferences, op3_mix_sources, op4_jump_sharding, op5_decontaminate, op6_html_text, op7_token_counts, op8_suffix_tree_lm, op9_quality_rules, op10_language_id, op11_best_fit_packing, op12_periodic_runs, op13_merkle_manifest)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
