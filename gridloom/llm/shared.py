"""What the corpus operators share: published tables, a few expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.rounds import discard, new_path, publish, run_tables, written

__all__ = ["SPACES", "discard", "documents", "let", "new_path", "publish", "run_tables", "text_of", "with_text", "written"]

#: ASCII white space, as the contracts of the operators name it.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it, lambdas included."""
    return F.transform(F.array(value), body)[0]


def with_text(docs: DataFrame, doc: Column, text: Column) -> list[Column]:
    """The columns of docs, taken from the struct doc, with another text (and its n_chars)."""
    new = {"text": text, "n_chars": F.length(text)}
    return [new.get(c, doc[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
