"""Lookups as joins: exact, case-insensitive on display text, the first match from the top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.coerce import format_value
from gridloom.operators.rounds import running

#: Rows that a task may keep to find one by its number.
TOP_ROWS = 10_000


def lookup_key(df: DataFrame, column: str) -> Column:
    return F.upper(format_value(F.col(column), df.schema[column].dataType))


def first_rows(table: DataFrame, key: str, order: str) -> DataFrame:
    """The first row, by order, of each key; a grouped minimum, so a hot key is pre-aggregated."""
    others = [c for c in table.columns if c not in (key, order)]
    grouped = table.groupBy(lookup_key(table, key).alias("key_")).agg(F.min_by(F.struct(*others), F.col(order)).alias("row_"))
    return grouped.select("key_", *(F.col(f"row_.{c}").alias(c) for c in others))


def VLOOKUP(queries: DataFrame, value: str, table: DataFrame, key: str, order: str, result: str, alias: str = "found") -> DataFrame:
    """queries with the result of the first row of table whose key equals value; null (#N/A) if there is none.

    Spark broadcasts the looked-up table if it is small enough and shuffles both sides otherwise.
    """
    if result not in table.columns:
        raise ValueError(f"#REF!: the table has no column {result}")
    firsts = first_rows(table.select(F.col(key), F.col(order), F.col(result).alias(alias)), key, order)
    return queries.join(firsts, lookup_key(queries, value) == F.col("key_"), "left").drop("key_")


def HLOOKUP(table: DataFrame, header: str, row: int, order: str) -> DataFrame:
    """The value at `row` (1 is the header's own row) below the first column whose header matches; null (#N/A) if none does."""
    if row < 1:
        raise ValueError("#VALUE!: rows count from 1")
    match = next((c for c in table.columns if c.upper() == header.upper()), None)
    if match is None or row == 1:
        return table.sparkSession.range(1).select(F.lit(match).cast("string").alias("found"))
    return _row_at(table, order, row - 1).select(F.col(match).alias("found"))


def INDEX_ROWS(table: DataFrame, order: str) -> DataFrame:
    """table with row_no from 1 in the order of a column: places from a range sort, not from one task."""
    return running(table, [order], "row_no").withColumn("row_no", F.col("row_no") + 1)


def _row_at(table: DataFrame, order: str, row: int) -> DataFrame:
    """One row by its number: up to TOP_ROWS each task keeps so many rows at most, beyond it the rows are numbered."""
    if row <= TOP_ROWS:
        return table.orderBy(order).offset(row - 1).limit(1)
    return INDEX_ROWS(table, order).where(F.col("row_no") == row)


def INDEX(table: DataFrame, order: str, row: int, column: int) -> DataFrame:
    """The value at a row and column, counted from 1; no row (#REF!) outside the table."""
    names = [c for c in table.columns]
    if not (1 <= column <= len(names) and row >= 1):
        raise ValueError(f"#REF!: the table has {len(names)} columns, and rows count from 1")
    return _row_at(table, order, row).select(F.col(names[column - 1]).alias("value"))


def MATCH(queries: DataFrame, value: str, table: DataFrame, key: str, place: str, alias: str = "place") -> DataFrame:
    """queries with the smallest place of a row whose key equals value; null (#N/A) if there is none."""
    firsts = table.groupBy(lookup_key(table, key).alias("key_")).agg(F.min(place).alias(alias))
    return queries.join(firsts, lookup_key(queries, value) == F.col("key_"), "left").drop("key_")
