"""Grid operators over cells made of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import grid
from gridloom.plans.log_queries import table
from gridloom.sources import delimited

_COLUMNS = ["c_name", "c_mktsegment", "c_nationkey"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.to_cells(table(spark, sf_dir, "customer"), "c_custkey", _COLUMNS)


def _places(cells: DataFrame) -> DataFrame:
    return cells.select("row", "col", "text")


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


def grid_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 800 + 1).cast("int").alias("col")).withColumn("address", grid.address(F.col("p_partkey"), F.col("col")))
    row, col = grid.parse_address(F.col("address"))
    return keys.select("p_partkey", "col", row.alias("row_back"), col.cast("int").alias("col_back"))


def grid_insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(grid.insert_rows(_cells(spark, sf_dir), 10, 3))


def grid_delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(grid.delete_rows(_cells(spark, sf_dir), 5, 4))


def grid_insert_delete_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(grid.delete_cols(grid.insert_cols(_cells(spark, sf_dir), 2, 2), 1, 1))


def grid_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(grid.select_ranges(_cells(spark, sf_dir), [(1, 1, 20, 2), (30, 3, 10, 1)]))


def grid_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(grid.clear(_cells(spark, sf_dir), 3, 1, 40, 2))


def grid_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(grid.find(_cells(spark, sf_dir), "build"))


def grid_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(grid.dedup_rows(_cells(spark, sf_dir), 1, 2, 1_000_000_000, 3))


def grid_distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.distinct_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"], "c_custkey")


def grid_sort_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(grid.sort_column(_cells(spark, sf_dir), 2, True))


def grid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.to_table(_cells(spark, sf_dir), 3).drop("sheet")


def grid_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.copy_tsv(_cells(spark, sf_dir), 2, 2, 30, 3).drop("sheet")


def grid_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("sheet"), F.concat("s_name", F.lit("\t1,5\n\t"), F.col("s_suppkey").cast("string")).alias("text"))
    return grid.paste_tsv(blocks, 4, 2)


def grid_set_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    values = cells.where("col = 2 and row % 3 = 0").select("sheet", "row", "col", F.when(F.col("row") % 2 == 0, F.lit("")).otherwise(F.lit("NEW")).alias("text"))
    return _places(grid.set_values(cells, values))


def grid_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = _cells(spark, sf_dir).withColumn("text", F.concat(F.when(F.col("row") % 2 == 0, F.lit("  ")).otherwise(F.lit("")), F.col("text")))
    return grid.trim_spaces(padded).groupBy("col").agg(F.count_if("changed").alias("n_changed"), F.count(F.lit(1)).alias("n"))


def grid_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.extent(_cells(spark, sf_dir))


def grid_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.max_width(_cells(spark, sf_dir), 6, 15).drop("sheet")


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    return table(spark, sf_dir, "part").select((k % 10).cast("string").alias("sheet"), k.alias("r1"), (k % 5).alias("c1"), (k + k % 3).alias("r2"), (k % 5 + 1).alias("c2"))


def _new_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("int")
    return table(spark, sf_dir, "supplier").select((k % 10).cast("string").alias("sheet"), (k * 10).alias("r1"), F.lit(0).alias("c1"), (k * 10 + k % 4).alias("r2"), (k % 2).alias("c2"))


def grid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.merge_cells(_merges(spark, sf_dir), _new_merges(spark, sf_dir))


def grid_unmerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.unmerge(_merges(spark, sf_dir), _new_merges(spark, sf_dir))


def grid_sort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.sort_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name"), ["c_nationkey", "c_name"], [True, False])


def grid_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = grid.row_totals(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber"])
    return totals.select(F.round("l_quantity", 2).alias("l_quantity"), F.round("l_linenumber", 2).alias("l_linenumber"))


def grid_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')).alias("quoted"), "p_size")
    return delimited.as_lines(rows)


QUERIES = {f.__name__: f for f in (
    grid_cells, grid_addresses, grid_insert_rows, grid_delete_rows, grid_insert_delete_cols, grid_select, grid_clear, grid_find, grid_dedup, grid_distinct_rows,
    grid_sort_column, grid_table, grid_copy, grid_paste, grid_set_values, grid_trim, grid_extent, grid_widths, grid_merge, grid_unmerge, grid_sort_rows, grid_totals, grid_csv_lines,
)}

_C = """
        WITH cells AS (SELECT c_custkey AS row, 1 AS col, c_name AS text FROM customer UNION ALL SELECT c_custkey, 2, c_mktsegment FROM customer
                       UNION ALL SELECT c_custkey, 3, CAST(c_nationkey AS VARCHAR) FROM customer) """
_M = """
        WITH m AS (SELECT CAST(p_partkey % 10 AS VARCHAR) AS sheet, CAST(p_partkey AS INTEGER) AS r1, CAST(p_partkey % 5 AS INTEGER) AS c1,
                          CAST(p_partkey + p_partkey % 3 AS INTEGER) AS r2, CAST(p_partkey % 5 + 1 AS INTEGER) AS c2 FROM part),
             s AS (SELECT CAST(s_suppkey % 10 AS VARCHAR) AS sheet, CAST(s_suppkey * 10 AS INTEGER) AS r1, CAST(0 AS INTEGER) AS c1,
                          CAST(s_suppkey * 10 + s_suppkey % 4 AS INTEGER) AS r2, CAST(s_suppkey % 2 AS INTEGER) AS c2 FROM supplier) """
_MEET = "m.sheet = s.sheet AND m.r1 <= s.r2 AND m.r2 >= s.r1 AND m.c1 <= s.c2 AND m.c2 >= s.c1"
SQL = {
    "grid_cells": _C + "SELECT 'Sheet1' AS sheet, row, col, text, CASE WHEN col = 3 THEN CAST(text AS DOUBLE) END AS num FROM cells",
    "grid_addresses": "SELECT p_partkey, CAST(p_partkey % 800 + 1 AS INTEGER) AS col, CAST(p_partkey AS INTEGER) AS row_back, CAST(p_partkey % 800 + 1 AS INTEGER) AS col_back FROM part",
    "grid_insert_rows": _C + "SELECT CASE WHEN row >= 10 THEN row + 3 ELSE row END AS row, col, text FROM cells",
    "grid_delete_rows": _C + "SELECT CASE WHEN row >= 9 THEN row - 4 ELSE row END AS row, col, text FROM cells WHERE row NOT BETWEEN 5 AND 8",
    "grid_insert_delete_cols": _C + "SELECT row, CASE WHEN col >= 2 THEN col + 1 END AS col, text FROM cells WHERE col > 1",
    "grid_select": _C + "SELECT row, col, text FROM cells WHERE (row BETWEEN 1 AND 20 AND col <= 2) OR row BETWEEN 10 AND 30",
    "grid_clear": _C + "SELECT row, col, text FROM cells WHERE NOT (row BETWEEN 3 AND 40 AND col <= 2)",
    "grid_find": _C + "SELECT row, col, text FROM cells WHERE contains(upper(text), 'BUILD')",
    "grid_dedup": _C + """, k AS (SELECT c_custkey AS row, min(c_custkey) OVER (PARTITION BY upper(c_mktsegment), c_nationkey) AS first FROM customer WHERE c_custkey >= 1)
        SELECT row, col, text FROM cells LEFT JOIN k USING (row) WHERE col = 1 OR row = coalesce(first, row)""",
    "grid_distinct_rows": "SELECT min(c_custkey) AS c_custkey, c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey",
    "grid_sort_column": """
        SELECT row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey) AS row, 2 AS col, c_mktsegment AS text FROM customer
        UNION ALL SELECT c_custkey, 1, c_name FROM customer UNION ALL SELECT c_custkey, 3, CAST(c_nationkey AS VARCHAR) FROM customer""",
    "grid_table": "SELECT c_custkey AS row, c_name AS c1, c_mktsegment AS c2, CAST(c_nationkey AS VARCHAR) AS c3 FROM customer",
    "grid_copy": r"SELECT c_custkey AS row, c_mktsegment || chr(9) || c_nationkey AS line FROM customer WHERE c_custkey BETWEEN 2 AND 30",
    "grid_paste": """
        SELECT s_name AS sheet, CAST(4 AS BIGINT) AS row, 2 AS col, s_name AS text, CAST(NULL AS DOUBLE) AS num FROM supplier
        UNION ALL SELECT s_name, 4, 3, '1,5', 15.0 FROM supplier UNION ALL SELECT s_name, 5, 3, CAST(s_suppkey AS VARCHAR), CAST(s_suppkey AS DOUBLE) FROM supplier""",
    "grid_set_values": _C + "SELECT row, col, CASE WHEN col = 2 AND row % 3 = 0 THEN 'NEW' ELSE text END AS text FROM cells WHERE NOT (col = 2 AND row % 6 = 0)",
    "grid_trim": _C + "SELECT col, count(*) FILTER (WHERE row % 2 = 0) AS n_changed, count(*) AS n FROM cells GROUP BY col",
    "grid_extent": _C + "SELECT max(row) AS max_row, max(col) AS max_col FROM cells",
    "grid_widths": _C + "SELECT col, CAST(greatest(6, least(15, max(length(text)))) AS INTEGER) AS width FROM cells GROUP BY col",
    "grid_merge": _M + f", n AS (SELECT * FROM s WHERE r1 < r2 OR c1 < c2) SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM n AS s WHERE {_MEET}) UNION ALL SELECT * FROM n",
    "grid_unmerge": _M + f"SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE {_MEET})",
    "grid_sort_rows": "SELECT c_custkey, c_nationkey, c_name FROM customer ORDER BY c_nationkey DESC, c_name",
    "grid_totals": "SELECT round(sum(l_quantity), 2) AS l_quantity, CAST(sum(l_linenumber) AS DOUBLE) AS l_linenumber FROM lineitem",
    "grid_csv_lines": "SELECT p_partkey || ',\"' || p_brand || ', \"\"' || p_type || '\"\"\",' || p_size AS line FROM part",
}
