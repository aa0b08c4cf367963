"""Fragments, runs and styles made of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import fragments as R
from gridloom.operators import styles
from gridloom.plans.log_queries import table


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fragments: a line per line number, up to two apart in height, columns 60 points apart."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    cells = lines.select("l_orderkey", "l_linenumber", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("text")) for k, c in enumerate(("part", "supp"))))).alias("c"))
    return cells.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), "c.text", (F.col("c.k") * 60.0 + 10).alias("x"),
        (800.0 - F.col("l_linenumber") * 20 + F.col("c.k")).alias("y"), (F.lit(57.0) - F.col("l_linenumber")).alias("width"), F.lit(10.0).alias("size"))


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.text_lines(_fragments(spark, sf_dir))


def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tables(_fragments(spark, sf_dir)).select("doc_id", "row_no", F.array_join("cells", "|").alias("cells"))


def layout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("block_id"), F.col("event_id").alias("run_no"), F.left("event_type", F.lit(1)).alias("text"), (F.col("event_type") == "view").alias("bold"))
    return R.merge_runs(runs, ["bold"])


def layout_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = R.map_point(F.col("p_size"), F.col("p_retailprice"), (100.0, 800.0), (1920.0, 1080.0))
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"))


def layout_split_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.split_run(F.col("p_name"), 2, 5)
    return table(spark, sf_dir, "part").select("p_partkey", parts[0].alias("before"), parts[1].alias("within"), parts[2].alias("after"))


def style_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("font"), F.when(F.col("p_size") > 10, F.col("p_size") % 3).alias("bold"))
    return styles.with_style_ids(cells, ["font", "bold"]).select("p_partkey", F.col("style_id").cast("bigint").alias("style_id"))


def style_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*(F.lit(c) for c in ("Integer", "percent", "date", "none"))), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("code"))
    return codes.select("n_nationkey", styles.pattern_of(F.col("code")).alias("pattern"), styles.code_of(styles.pattern_of(F.col("code"))).alias("code"))


QUERIES = {f.__name__: f for f in (layout_lines, layout_tables, layout_runs, layout_points, layout_split_run, style_ids, style_patterns)}

_L = """
        WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS part, min(l_suppkey) AS supp,
                          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS no FROM lineitem GROUP BY 1, 2) """
SQL = {
    "layout_lines": _L + """
        SELECT doc_id, 1 AS page_no, CAST(no AS INTEGER) AS line_no, part || CASE WHEN 3 + n > 10 THEN '    ' ELSE ' ' END || supp AS text FROM l""",
    "layout_tables": _L + "SELECT doc_id, CAST(no AS INTEGER) AS row_no, part || '|' || supp AS cells FROM l",
    "layout_runs": """
        WITH e AS (SELECT user_id AS block_id, event_id AS run_no, left(event_type, 1) AS text, event_type = 'view' AS bold FROM events),
             s AS (SELECT *, CASE WHEN bold = lag(bold) OVER (PARTITION BY block_id ORDER BY run_no) THEN 0 ELSE 1 END AS opens FROM e),
             g AS (SELECT *, sum(opens) OVER (PARTITION BY block_id ORDER BY run_no) AS g FROM s)
        SELECT block_id, bold, min(run_no) AS run_no, string_agg(text, '' ORDER BY run_no) AS text FROM g GROUP BY block_id, bold, g""",
    "layout_points": "SELECT p_partkey, round(p_size * 19.2::DOUBLE) AS x, round(p_retailprice * 1.35::DOUBLE) AS y FROM part",
    "layout_split_run": 'SELECT p_partkey, substr(p_name, 1, 2) AS "before", substr(p_name, 3, 3) AS within, substr(p_name, 6) AS "after" FROM part',
    "style_ids": """
        WITH c AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand END AS font, CASE WHEN p_size > 10 THEN p_size % 3 END AS bold FROM part)
        SELECT p_partkey, CASE WHEN font IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY font NULLS FIRST, bold) - CAST((SELECT count(*) > 0 FROM c WHERE font IS NULL) AS INTEGER) END AS style_id FROM c""",
    "style_patterns": """
        SELECT n_nationkey, ['#,##0', '0.0%', 'dd/mm/yyyy', NULL][n_nationkey % 4 + 1] AS pattern, ['integer', 'percent', 'date', NULL][n_nationkey % 4 + 1] AS code FROM nation""",
}
