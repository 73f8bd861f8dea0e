"""Queries of the training-data operators, and their DuckDB forms where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbitgrid.llm import bpe, context_tree, decision_list, decontam, hard_negatives, host_reputation, license_rules, packing, quality_knn, simhash, spelling, token_counts, token_store
from orbitgrid.llm.common import read_table


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return host_reputation.judged(pages, host_reputation.labelled_outcomes(pages, read_table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.with_lengths(read_table(spark, sf_dir, "documents").select("text")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scanned(read_table(spark, sf_dir, "documents"))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(read_table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(read_table(spark, sf_dir, "documents"))


def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe_codec, op2_simhash_golay, op3_quality_knn, op4_host_reputation, op5_decontamination,
        op6_token_counts, op7_license_scan, op8_decision_list, op9_context_tree, op10_token_store,
        op11_spelling_variants, op12_pattern_packing, op13_hard_negatives,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op4_host_reputation": host_reputation.ORACLE_SQL,
    "op5_decontamination": decontam.ORACLE_SQL,
    "op7_license_scan": license_rules.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
