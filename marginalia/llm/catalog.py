"""Queries over the driver tables and their SQL, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import (
    decontaminate,
    jaccard_join,
    line_dedup,
    lm_score,
    mixing,
    pii,
    quality_classifier,
    quality_rules,
    substring_dedup,
    suffix_dedup,
)
from marginalia.llm.common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents")).drop("kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixing(table(spark, sf_dir, "documents")).drop("margin_error")
    return out.withColumns({"weight": F.round("weight", 9), "p": F.round("p", 9)})


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_quality_rules": op4_quality_rules,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_line_dedup": op6_line_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_pii": op8_pii,
        "op9_mixing": op9_mixing,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    from marginalia.llm import sql

    return {"op4_quality_rules": sql.OP4, "op5_benchmark_decontamination": sql.OP5, "op6_line_dedup": sql.OP6, "op9_mixing": sql.OP9}
