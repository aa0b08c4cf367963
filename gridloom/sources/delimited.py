"""Delimited text: spreadsheet CSV (a cell per value) and table CSV (rows of strings)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.coerce import text_to_number
from gridloom.operators import grid


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Of comma, semicolon and tab the one most frequent in the first five lines; tab wins ties, then comma."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(5).collect())
    commas, semicolons, tabs = head.count(","), head.count(";"), head.count("\t")
    if tabs and tabs >= max(commas, semicolons):
        return "\t"
    return ";" if semicolons > commas else ","


def read_rows(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Table CSV: quotes may hold line breaks, nothing is trimmed, blank rows are dropped. Columns _c0, _c1, ..."""
    rows = spark.read.csv(path, sep=separator, quote='"', escape='"', multiLine=True, inferSchema=False)
    filled = F.array(*(F.coalesce(F.col(c), F.lit("")) for c in rows.columns))
    return rows.where(F.exists(filled, lambda v: F.trim(v) != ""))


def read_cells(spark: SparkSession, path: str, separator: str = ",", sheet: str | None = None) -> DataFrame:
    """Spreadsheet CSV, one line per row: values trimmed, numbers inferred, text starting with = is a formula, blanks dropped.

    Row numbers follow the lines of each file; a file is a sheet of its own name, or all are `sheet`. Files are read in
    blocks, lines are numbered within their block, and the blocks' counts (a row per block) give the offsets.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    counts = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    within = F.row_number().over(Window.partitionBy("path", "block").orderBy("id"))
    lines = lines.withColumn("within", within).join(counts.select("path", "block", before.alias("before")), ["path", "block"])
    mark = re.escape(separator)
    pattern = rf'(?:^|{mark})(?:"((?:[^"]|"")*)"|([^{mark}]*))'
    quoted, plain = F.regexp_extract_all("value", F.lit(pattern), F.lit(1)), F.regexp_extract_all("value", F.lit(pattern), F.lit(2))
    values = F.zip_with(quoted, plain, lambda q, p: F.trim(F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(p)))
    name = F.lit(sheet) if sheet else F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    cells = lines.select(name.alias("sheet"), (F.col("before") + F.col("within")).cast("bigint").alias("row"), F.posexplode(values).alias("c", "text")).where("text <> ''")
    return cells.select(
        "sheet", "row", (F.col("c") + 1).alias("col"), "text", text_to_number(F.col("text")).alias("num"), F.when(F.col("text").startswith("="), F.col("text")).alias("formula")
    )


def quoted(value, separator: str = ","):
    """A value for a delimited file: in quotes only where needed."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    needed = F.contains(value, F.lit(separator)) | value.rlike(r'["\r\n]')
    return F.when(needed, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def write_rows(table: DataFrame, path: str, separator: str = ",", header: bool = False) -> None:
    table.write.csv(path, sep=separator, quote='"', escape='"', header=header, emptyValue="", nullValue="")


def as_lines(table: DataFrame, separator: str = ",") -> DataFrame:
    """A row's values as one delimited line."""
    return table.select(F.concat_ws(separator, *(quoted(F.col(c), separator) for c in table.columns)).alias("line"))


def sheet_lines(cells: DataFrame, separator: str = ",") -> DataFrame:
    """A sheet (row, col, text) as delimited lines (row, line), dense: every row up to the last, every column up to the last, blank or not. Rows are filled in many tasks."""
    extent = grid.extent(cells).first()
    rows = grid.range_rows(cells.withColumn("sheet", F.lit("sheet")), 1, 1, extent.max_row, extent.max_col)
    return rows.select("row", F.array_join(F.transform("texts", lambda t: quoted(t, separator)), separator).alias("line"))


def write_sheet(cells: DataFrame, path: str, separator: str = ",") -> None:
    """sheet_lines as files in the order of rows; the first begins with a byte order mark, so that spreadsheets take it for UTF-8."""
    lines = sheet_lines(cells, separator).repartitionByRange("row").sortWithinPartitions("row")
    mark = F.when(F.col("row") == 1, F.lit("\ufeff")).otherwise("")
    lines.select(F.concat(mark, "line").alias("value")).write.text(path)
