"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hostshelf.llm import byte_bpe, content_sort, fim_chunks, lang_backoff, license_diagonals, line_neighbours, phrase_automata, phrase_counting, quality_risk, repeat_tree, residual_packing, simhash_cover, vocab, window_packing
from hostshelf.llm.common import documents


def op1_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.report(documents(spark, sf_dir))


def op2_repeat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_tree.report(documents(spark, sf_dir))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_cover.report(documents(spark, sf_dir), shingle=4, radius=4)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(documents(spark, sf_dir), vocab.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op5_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_backoff.report(documents(spark, sf_dir))


def op6_line_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_neighbours.report(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_diagonals.report(documents(spark, sf_dir))


def op8_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.report(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_risk.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_fim_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_chunks.report(documents(spark, sf_dir))


def op12_phrase_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_counting.report(documents(spark, sf_dir))


def op13_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_phrase_automata, op2_repeat_tree, op3_simhash_near_dedup, op4_byte_bpe, op5_language_backoff, op6_line_neighbours, op7_license_scan, op8_window_packing, op9_exact_dedup, op10_quality_rules, op11_fim_chunks, op12_phrase_counting, op13_residual_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_phrase_automata": phrase_automata.ORACLE, "op9_exact_dedup": content_sort.ORACLE, "op10_quality_rules": quality_risk.ORACLE,
            "op11_fim_chunks": fim_chunks.ORACLE, "op12_phrase_counting": phrase_counting.ORACLE}
