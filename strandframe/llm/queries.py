"""The queries of this subpackage: each applies one operator to its whole table. ORACLE has their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandframe.llm import decontaminate, filter_audit, lines, mixing, nndescent, pieces, quality, simhash, token_counts, tokens, toxicity, url_rules, whitening
from strandframe.llm.common import load


def op1_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op1_query(load(spark, sf_dir, "documents"))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2_query(load(spark, sf_dir, "documents"))


def op3_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.op3_query(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.op4_query(load(spark, sf_dir, "embeddings"))


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op5_query(load(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6_query(load(spark, sf_dir, "documents"))


def op7_pfor_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op7_query(load(spark, sf_dir, "documents"))


def op8_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_window_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op9_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op10_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11_query(load(spark, sf_dir, "embeddings"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op12_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op13_query(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_length_histogram": op1_length_histogram,
    "op2_pivotal_mix": op2_pivotal_mix,
    "op3_url_association_rules": op3_url_association_rules,
    "op4_nn_descent": op4_nn_descent,
    "op5_fuzzy_line_dedup": op5_fuzzy_line_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_pfor_token_shards": op7_pfor_token_shards,
    "op8_mil_toxicity": op8_mil_toxicity,
    "op9_window_decontamination": op9_window_decontamination,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_exact_whitening": op11_exact_whitening,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE: dict[str, str] = {"op12_filter_interactions": filter_audit.SQL}
