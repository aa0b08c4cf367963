"""The corpus operators as named queries over the whole documents table, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run as run_pipeline
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import (
    byte_pairs,
    exact_dedup,
    hard_negatives,
    license_scan,
    line_dedup,
    merkle,
    mixing,
    near_dedup,
    packing,
    quality_rules,
    secret_scan,
    token_shards,
    toxicity,
)
from gridloom.llm.oracle import SQL
from gridloom.llm.shared import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(documents(spark, sf_dir))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_report(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.byte_pair_report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mining_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_token_shards": op2_token_shards,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pack_sequences": op6_pack_sequences,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": run_pipeline,
}

if PIPELINE_SQL:
    SQL["pipeline"] = PIPELINE_SQL
