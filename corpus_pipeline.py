"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing to target weights, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Nulls, empties and the like in a stage: a null or blank text has no words, so the quality rules reject it and later stages, given one, keep it
as it is (near copies of each other; size 0 in the mix; the end id alone in packing). A null doc_id, source or other column is kept;
null is a source of its own. Rows that repeat doc_id and text share one outcome: all stay or go together in the first two stages, one
of them stays in the third, and each counts for itself after it. Texts of any length are whole throughout. Other columns, whatever their
names, pass through all stages but the last. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from gridloom.llm.shared import discard, documents, publish, run_tables

#: Near copies: texts whose sets of five-word shingles have at least this Jaccard similarity.
SHINGLE = 5
SIMILARITY = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that fail a rule are removed from the others."""
    return quality_rules.clean_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing remains."""
    return line_dedup.drop_repeated_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.drop_near_copies(docs, SHINGLE, SIMILARITY)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard."""
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packing_report(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: Token ids and seeded hash orders can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with run_tables():
        for name, stage in STAGES:
            docs = publish(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            discard(spark, keep=1)  # a stage's own rounds and its input are used up
    return docs
