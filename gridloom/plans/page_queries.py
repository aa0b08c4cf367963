"""Document and page operators: every 3 lines of a document are a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import pages as P
from gridloom.plans.log_queries import table

LINES = 3


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.to_pages(table(spark, sf_dir, "documents").select("doc_id", "text"), LINES)


def _keys(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "page_no", F.md5("text").alias("md5"))


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(_pages(spark, sf_dir))


def page_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(P.select_pages(_pages(spark, sf_dir), P.parse_pages("1, 3-4, 8", 10)))


def page_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(P.renumber(P.remove_pages(_pages(spark, sf_dir), [1, 3])))


def page_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(P.matching(_pages(spark, sf_dir), "even"))


def page_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(P.reverse(_pages(spark, sf_dir)))


def page_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(P.reorder(_pages(spark, sf_dir), [3, 1]))


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_every(_pages(spark, sf_dir), 2).groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n"))


def page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(P.merge_documents(_pages(spark, sf_dir)))


def page_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = P.rotate(_pages(spark, sf_dir).withColumn("rotation", F.lit(270)), 180, [2, 4])
    return turned.groupBy("page_no", "rotation").agg(F.count(F.lit(1)).alias("n"))


def page_n_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.n_up(_pages(spark, sf_dir), 4, 2).select("doc_id", "page_no", "sheet_no", "slot", "grid_row", "grid_col")


def page_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = F.col("p_size") * 10.0, F.col("p_retailprice")
    scale, left, top = P.fit(width, height, 595.0, 842.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scale, 6).alias("scale"), F.round(left, 4).alias("left"), F.round(top, 4).alias("top"))


def page_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 60 + 1).alias("page_no"))
    return P.describe_pages(hits)


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extract_text(_pages(spark, sf_dir)).select("doc_id", F.md5("text").alias("md5"))


def page_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.find_text(_pages(spark, sf_dir), "the").select("doc_id", "page_no", "hits")


def page_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.replace_text(_pages(spark, sf_dir), "the", "THE").select("doc_id", "page_no", F.col("replaced").cast("bigint").alias("replaced"), F.md5("text").alias("md5"))


def page_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.redact(_pages(spark, sf_dir), "stupid", "*").where("replaced > 0").select("doc_id", "page_no", F.md5("text").alias("md5"))


def page_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _pages(spark, sf_dir)
    right = left.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "^[^\n]*", "edited line")).otherwise(F.col("text")))
    return P.compare_documents(left, right)


def page_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.inspect(_pages(spark, sf_dir))


def page_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.canonical_objects(table(spark, sf_dir, "documents"), "doc_id", "text")


def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    xs = xs.withColumn("xs", F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: k * 9.0))
    return xs.select("l_orderkey", F.size(P.detect_columns(F.col("xs"))).alias("n_columns"))


def page_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = P.placeholders(F.lit("{file}: {page}/{pages} on {date}"), F.col("p_partkey"), F.col("p_size"), F.col("p_name"), F.lit("01/02/2026"))
    return table(spark, sf_dir, "part").select(shown.alias("footer"))


def page_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = P.column_widths(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])
    return widths.select(*(F.round(c, 6).alias(c) for c in ("p_name", "p_brand", "p_type")))


QUERIES = {f.__name__: f for f in (
    page_split, page_select, page_remove, page_even, page_reverse, page_reorder, page_parts, page_merge, page_rotate, page_n_up, page_fit, page_describe, page_text,
    page_find, page_replace, page_redact, page_compare, page_inspect, page_canonical, page_columns, page_placeholders, page_widths,
)}

_P = f"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
             p AS (SELECT doc_id, CAST((no - 1) // {LINES} + 1 AS INTEGER) AS page_no, string_agg(line, chr(10) ORDER BY no) AS text FROM l GROUP BY 1, 2) """
_NUMBERED = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {}) AS INTEGER) AS page_no"
SQL = {
    "page_split": _P + "SELECT doc_id, page_no, md5(text) AS md5 FROM p",
    "page_select": _P + "SELECT doc_id, page_no, md5(text) AS md5 FROM p WHERE page_no IN (1, 3, 4, 8)",
    "page_remove": _P + f"SELECT doc_id, {_NUMBERED.format('page_no')}, md5(text) AS md5 FROM p WHERE page_no NOT IN (1, 3)",
    "page_even": _P + "SELECT doc_id, page_no, md5(text) AS md5 FROM p WHERE page_no % 2 = 0",
    "page_reverse": _P + f"SELECT doc_id, {_NUMBERED.format('page_no DESC')}, md5(text) AS md5 FROM p",
    "page_reorder": _P + f"SELECT doc_id, {_NUMBERED.format('CASE page_no WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END, page_no')}, md5(text) AS md5 FROM p",
    "page_parts": _P + "SELECT doc_id, CAST((page_no - 1) // 2 + 1 AS INTEGER) AS part, count(*) AS n FROM p GROUP BY 1, 2",
    "page_merge": _P + "SELECT 'merged' AS doc_id, row_number() OVER (ORDER BY doc_id, page_no) AS page_no, md5(text) AS md5 FROM p",
    "page_rotate": _P + "SELECT page_no, CAST(CASE WHEN page_no IN (2, 4) THEN 90 ELSE 270 END AS INTEGER) AS rotation, count(*) AS n FROM p GROUP BY page_no",
    "page_n_up": _P + """SELECT doc_id, page_no, CAST((page_no - 1) // 4 + 1 AS INTEGER) AS sheet_no, CAST((page_no - 1) % 4 AS INTEGER) AS slot,
               CAST((page_no - 1) % 4 // 2 AS INTEGER) AS grid_row, CAST((page_no - 1) % 4 % 2 AS INTEGER) AS grid_col FROM p""",
    "page_fit": """
        WITH s AS (SELECT p_partkey, p_size * 10.0::DOUBLE AS w, p_retailprice AS h, least(595.0::DOUBLE / (p_size * 10.0::DOUBLE), 842.0::DOUBLE / p_retailprice) AS k FROM part)
        SELECT p_partkey, round(k, 6) AS scale, round((595.0::DOUBLE - w * k) / 2, 4) AS "left", round((842.0::DOUBLE - h * k) / 2, 4) AS top FROM s""",
    "page_describe": """
        WITH d AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey % 60 + 1 AS n FROM lineitem),
             i AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM d),
             r AS (SELECT doc_id, min(n) AS a, max(n) AS b FROM i GROUP BY doc_id, g)
        SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY doc_id""",
    "page_text": _P + "SELECT doc_id, md5(string_agg(text, chr(10) || chr(12) || chr(10) ORDER BY page_no)) AS md5 FROM p GROUP BY doc_id",
    "page_find": _P + """, h AS (SELECT doc_id, page_no, CAST((length(text) - length(replace(upper(text), 'THE', ''))) / 3 AS BIGINT) AS hits FROM p)
        SELECT doc_id, page_no, hits FROM h WHERE hits > 0""",
    "page_replace": _P + "SELECT doc_id, page_no, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS replaced, md5(replace(text, 'the', 'THE')) AS md5 FROM p",
    "page_redact": _P + "SELECT doc_id, page_no, md5(regexp_replace(text, 'stupid', '******', 'gi')) AS md5 FROM p WHERE regexp_matches(text, 'stupid', 'i')",
    "page_compare": _P + """, a AS (SELECT doc_id, page_no, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM p),
             b AS (SELECT doc_id, page_no, trim(unnest(string_split(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^[^\\n]*', 'edited line') ELSE text END, chr(10))), ' ') AS line FROM p),
             d AS (SELECT doc_id, page_no, line, sum(k) AS k FROM (SELECT *, 1 AS k FROM a UNION ALL SELECT *, -1 FROM b) WHERE line <> '' GROUP BY ALL),
             s AS (SELECT doc_id, page_no, CAST(sum(greatest(k, 0)) AS BIGINT) AS removed, CAST(sum(greatest(-k, 0)) AS BIGINT) AS added FROM d GROUP BY 1, 2)
        SELECT * FROM s WHERE removed > 0 OR added > 0""",
    "page_inspect": _P + r"""
        SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS BIGINT) AS words,
               count(*) FILTER (WHERE trim(text, ' ') = '') AS blank_pages FROM p GROUP BY doc_id""",
    "page_canonical": """
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical, count(*) OVER (PARTITION BY text) AS copies FROM documents""",
    "page_columns": "SELECT l_orderkey, CAST((max(l_linenumber) - 1) // 2 + 1 AS INTEGER) AS n_columns FROM lineitem GROUP BY l_orderkey",
    "page_placeholders": "SELECT p_name || ': ' || p_partkey || '/' || p_size || ' on 01/02/2026' AS footer FROM part",
    "page_widths": """
        WITH w AS (SELECT greatest(3, least(40, max(length(p_name)))) AS a, greatest(3, least(40, max(length(p_brand)))) AS b, greatest(3, least(40, max(length(p_type)))) AS c FROM part)
        SELECT round(a / (a + b + c), 6) AS p_name, round(b / (a + b + c), 6) AS p_brand, round(c / (a + b + c), 6) AS p_type FROM w""",
}
