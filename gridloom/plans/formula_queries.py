"""Formula semantics: criteria, truth, comparisons, text in numeric places, arguments per row, dates in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import aggregates as A
from gridloom.functions import coerce, lookup
from gridloom.functions import scalars as S
from gridloom.plans.log_queries import table


def _pick(key: Column, *texts: str | None) -> Column:
    return F.element_at(F.array(*(F.lit(t) for t in texts)), (key % len(texts) + 1).cast("int"))


def fn_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity, flag, text = F.col("l_quantity"), F.col("l_returnflag"), T.StringType()
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(
        A.COUNTIF(quantity, "!=5").alias("not_five"), A.COUNTIF(quantity, ' <> "5" ').alias("quoted"), A.COUNTIF(flag, '="r"', text).alias("r"), A.COUNTIF(flag, '"R"', text).alias("plain"),
        A.COUNTIF(flag, "!=R", text).alias("not_r"), A.COUNTIF(quantity, "").alias("blank"), F.round(A.SUMIF(quantity, ">= 25", F.col("l_extendedprice").cast("string")), 2).alias("price"),
    )


def fn_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, no, nation = F.lit("yes"), F.lit("no"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.IF(nation, yes, no).alias("number"), S.IF(_pick(F.col("c_custkey"), "6", "FALSE", "#N/A", "", None), yes, no).alias("text"), S.IF(F.col("c_acctbal").cast("decimal(12,2)") * 0, yes, no).alias("zero"),
        S.AND(nation, F.col("c_name"), nation > 3).alias("and"), S.OR(F.lit(None).cast("double"), nation).alias("or"), S.NOT(nation).alias("not"),
    )


def fn_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    left, right = _pick(key, "1,000", "abc", "ABC", "(5)", "", "12"), _pick(key, "1000", "'ABC'", "abd", "-5", "", "12.00000001")
    names = {"=": "eq", "<>": "ne", "!=": "ne2", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}
    tests = [coerce.compare(left, o, right, T.StringType(), T.StringType()).alias(n) for o, n in names.items()]
    return table(spark, sf_dir, "part").select("p_partkey", *tests, coerce.compare(F.col("p_size"), ">", F.col("p_retailprice") / 50).alias("numbers"))


def fn_text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of a text column whose type isn't told: numbers in text count, the rest is skipped."""
    rows = table(spark, sf_dir, "part").select("p_brand", _pick(F.col("p_partkey"), "1,234.5", "(5)", " 12 ", "1e3", "12d", "abc", None).alias("t"))
    t = F.col("t")
    return rows.groupBy("p_brand").agg(
        A.SUM(t).alias("sum"), F.round(A.AVERAGE(t), 6).alias("average"), A.MIN(t).alias("min"), A.MAX(t).alias("max"), A.MEDIAN(t).alias("median"), F.round(A.STDEV(t), 6).alias("stdev"),
        A.COUNTIF(t, ">10").alias("many"), A.SUMIF(t, "<>12").alias("not_twelve"),
    )


def fn_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, size = _pick(F.col("p_partkey"), "7", "x", None), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.ADD(t, size).alias("add"), S.SUBTRACT(size, t).alias("subtract"), S.MULTIPLY(size, t).alias("multiply"), S.MULTIPLY(t, size).alias("multiply_left"), S.DIVIDE(size, t).alias("divide"))


def fn_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments that differ from row to row."""
    name, size, price = F.col("p_name"), F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.LEFT(name, size % 5).alias("left"), S.RIGHT(name, size % 4 - 1).alias("right"), S.MID(name, size % 7, size % 3 + 1).alias("mid"), S.SUBSTITUTE(name, F.left(name, F.lit(1)), F.col("p_brand")).alias("substitute"),
        S.FIND(F.right(name, F.lit(1)), name).alias("find"), S.REPT(F.lit("ab"), size % 4 - 1).alias("rept"), S.ROUND(price, size % 2 * 2).alias("round"), S.ROUNDUP(price, size % 2).alias("roundup"),
        S.ROUNDDOWN(price, F.lit(-3)).alias("rounddown"), S.CEILING(price, size % 4).alias("ceiling"), S.FLOOR(price, size % 4).alias("floor"),
    )


def fn_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % 5
    serial = coerce.date_to_serial(day.cast("date")).cast("bigint").cast("string")
    shown = F.when(key == 0, F.date_format(day, "dd/MM/yyyy")).when(key == 1, F.date_format(day, "yyyy-MM-dd")).when(key == 2, serial).when(key == 3, F.date_format(day, "d/M/yyyy HH:mm")).otherwise("no date")
    t, text = F.col("t"), T.StringType()
    rows = table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("t"), coerce.date_to_serial(day.cast("date")).alias("serial"))
    return rows.select(
        "o_orderkey", S.YEAR(t, text).alias("year"), S.MONTH(t, text).alias("month"), S.DAY(t, text).alias("day"), S.WEEKDAY(t, text).alias("weekday"), S.YEAR(F.col("serial") + 0.75, T.DoubleType()).alias("serial_year"))


def fn_hlookup_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    found = lookup.HLOOKUP(suppliers, "S_NAME", 1, "s_suppkey").unionByName(lookup.HLOOKUP(suppliers, "nowhere", 2, "s_suppkey"))
    return found.unionByName(lookup.HLOOKUP(suppliers, "s_name", 2, "s_suppkey")).unionByName(lookup.HLOOKUP(suppliers, "S_Name", 40, "s_suppkey"))


QUERIES = {f.__name__: f for f in (fn_criteria, fn_truth, fn_compare, fn_text_columns, fn_operators, fn_arguments, fn_date_text, fn_hlookup_header)}

SQL = {
    "fn_criteria": """
        SELECT l_linenumber, CAST(count(*) FILTER (WHERE l_quantity <> 5) AS DOUBLE) AS not_five, CAST(count(*) FILTER (WHERE l_quantity <> 5) AS DOUBLE) AS quoted,
               CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS plain,
               CAST(count(*) FILTER (WHERE l_returnflag <> 'R') AS DOUBLE) AS not_r, CAST(0 AS DOUBLE) AS blank, round(sum(l_extendedprice) FILTER (WHERE l_quantity >= 25), 2) AS price
        FROM lineitem GROUP BY l_linenumber""",
    "fn_truth": """
        SELECT c_custkey, CASE WHEN c_nationkey <> 0 THEN 'yes' ELSE 'no' END AS "number", CASE WHEN c_custkey % 5 <> 4 THEN 'yes' ELSE 'no' END AS "text", 'no' AS zero,
               c_nationkey > 3 AS "and", c_nationkey <> 0 AS "or", c_nationkey = 0 AS "not"
        FROM customer""",
    "fn_compare": """
        SELECT p_partkey, p_partkey % 6 <> 2 AS eq, p_partkey % 6 = 2 AS ne, p_partkey % 6 = 2 AS ne2, false AS gt, p_partkey % 6 IN (0, 3) AS ge, p_partkey % 6 = 5 AS lt, p_partkey % 6 IN (0, 3, 5) AS le,
               p_size > p_retailprice / 50 AS "numbers"
        FROM part""",
    "fn_text_columns": """
        WITH t AS (SELECT p_brand, CASE p_partkey % 7 WHEN 0 THEN 1234.5 WHEN 1 THEN -5 WHEN 2 THEN 12 WHEN 3 THEN 1000 END::DOUBLE AS v, p_partkey % 7 AS k FROM part)
        SELECT p_brand, coalesce(sum(v), 0) AS "sum", round(coalesce(avg(v), 0), 6) AS average, coalesce(min(v), 0) AS "min", coalesce(max(v), 0) AS "max", CAST(coalesce(median(v), 0) AS DOUBLE) AS median,
               round(stddev_samp(v), 6) AS stdev, CAST(count(*) FILTER (WHERE v > 10) AS DOUBLE) AS many, coalesce(sum(v) FILTER (WHERE v <> 12), 0) AS not_twelve
        FROM t GROUP BY p_brand""",
    "fn_operators": """
        WITH t AS (SELECT p_partkey, p_size::DOUBLE AS s, CASE WHEN p_partkey % 3 = 0 THEN 7.0::DOUBLE END AS n FROM part)
        SELECT p_partkey, coalesce(n, 0) + s AS "add", s - coalesce(n, 0) AS subtract, s * coalesce(n, 1) AS multiply, coalesce(n, 0) * s AS multiply_left, s / coalesce(n, 1) AS divide FROM t""",
    "fn_arguments": """
        SELECT p_partkey, left(p_name, p_size % 5) AS "left", CASE WHEN p_size % 4 > 1 THEN right(p_name, p_size % 4 - 1) ELSE '' END AS "right", substr(p_name, greatest(p_size % 7, 1), p_size % 3 + 1) AS mid,
               replace(p_name, left(p_name, 1), p_brand) AS substitute, CAST(instr(p_name, right(p_name, 1)) AS DOUBLE) AS find, repeat('ab', greatest(p_size % 4 - 1, 0)) AS rept,
               CASE WHEN p_size % 2 = 0 THEN round(p_retailprice, 0) ELSE round(p_retailprice, 2) END AS "round", CASE WHEN p_size % 2 = 0 THEN ceil(p_retailprice) ELSE ceil(p_retailprice * 10) / 10 END AS roundup,
               floor(p_retailprice) AS rounddown, CASE WHEN p_size % 4 = 0 THEN 0 ELSE ceil(p_retailprice / (p_size % 4)) * (p_size % 4) END::DOUBLE AS ceiling,
               CASE WHEN p_size % 4 = 0 THEN 0 ELSE floor(p_retailprice / (p_size % 4)) * (p_size % 4) END::DOUBLE AS "floor"
        FROM part""",
    "fn_date_text": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN year(o_orderdate)::DOUBLE END AS "year", CASE WHEN o_orderkey % 5 < 4 THEN month(o_orderdate)::DOUBLE END AS "month",
               CASE WHEN o_orderkey % 5 < 4 THEN day(o_orderdate)::DOUBLE END AS "day", CASE WHEN o_orderkey % 5 < 4 THEN (dayofweek(o_orderdate) + 1)::DOUBLE END AS weekday, year(o_orderdate)::DOUBLE AS serial_year
        FROM orders""",
    "fn_hlookup_header": """
        WITH n AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS no FROM supplier)
        SELECT 's_name' AS found UNION ALL SELECT NULL UNION ALL SELECT s_name FROM n WHERE no IN (1, 39)""",
}
