"""Spreadsheet functions over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import aggregates as A
from gridloom.functions import coerce, lookup
from gridloom.functions import scalars as S
from gridloom.plans.log_queries import table


def fn_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(A.SUM(q), 2).alias("sum_qty"), F.round(A.AVERAGE(price), 2).alias("avg_price"), A.COUNT(q).alias("count_qty"),
        A.COUNTA(q).alias("counta_qty"), A.COUNTBLANK(q).alias("blank_qty"), A.MIN(price).alias("min_price"), A.MAX(price).alias("max_price"),
        A.MEDIAN(q).alias("median_qty"), F.round(A.STDEV(q), 6).alias("stdev_qty"),
    )


def fn_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(
        A.COUNTIF(F.col("l_quantity"), ">25").alias("many"), A.COUNTIF(F.col("l_quantity"), "<>1").alias("not_one"),
        A.COUNTIF(mode, "r", T.StringType()).alias("returned"), F.round(A.SUMIF(F.col("l_quantity"), "<=10"), 2).alias("small_qty"),
        F.round(A.SUMIF(mode, "=A", F.col("l_extendedprice"), T.StringType()), 2).alias("a_price"), A.COUNTIF(mode, ">A", T.StringType()).alias("ordered_text"),
    )


def fn_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(A.PRODUCT(F.col("l_linenumber")).alias("product"))


def fn_textjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        A.TEXTJOIN(" | ", F.col("n_name"), F.col("n_nationkey")).alias("joined"), A.CONCAT(F.col("n_name"), F.col("n_nationkey")).alias("concat"))


def fn_status_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    average, count, total = A.status_bar(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(average, 2).alias("average"), count, F.round(total, 2).alias("sum"))


def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.ABS(x).alias("abs"), S.INT(x).alias("int"), S.SQRT(x).alias("sqrt"), F.round(S.POWER(x, 2), 2).alias("power"), S.MOD(F.col("c_custkey"), F.lit(7)).alias("mod"),
        (S.MOD(-F.col("c_custkey"), F.lit(7)) + 0.0).alias("mod_negative"), S.MOD(x, F.lit(0)).alias("mod_zero"), S.ROUND(x, 1).alias("round"), (S.ROUNDUP(x, 0) + 0.0).alias("roundup"),
        S.ROUNDDOWN(x, 0).alias("rounddown"), (S.CEILING(x, 50) + 0.0).alias("ceiling"), S.FLOOR(x, 50).alias("floor"), S.FLOOR(x, 0).alias("floor_zero"),
        F.coalesce(S.DIVIDE(F.lit(1.0), F.col("c_nationkey")), F.lit(-1.0)).alias("divide"),
    )


def fn_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.IF(x > 5000, F.lit("high"), F.lit("low")).alias("if"), S.AND(x > 0, F.col("c_nationkey") > 5).alias("and"), S.OR(x < 0, F.col("c_nationkey") == 3).alias("or"),
        S.NOT(x > 0).alias("not"), S.IFERROR(S.SQRT(x), F.lit(-1.0)).alias("iferror"), S.TRUE().alias("true"), S.FALSE().alias("false"),
    )


def fn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.LEN(name).alias("len"), S.UPPER(name).alias("upper"), S.LOWER(name).alias("lower"), S.PROPER(F.upper(name)).alias("proper"),
        S.TRIM(F.concat(F.lit("  "), name, F.lit("   x "))).alias("trim"), S.LEFT(name, 3).alias("left"), S.RIGHT(name, 4).alias("right"), S.MID(name, 2, 3).alias("mid"),
        S.MID(name, 0, 2).alias("mid_low"), S.SUBSTITUTE(name, "a", "@").alias("substitute"), S.FIND("e", name).alias("find"), S.REPT(F.lit("ab"), 3).alias("rept"),
        S.CONCAT(F.col("p_brand"), F.lit("-"), F.col("p_size")).alias("concat"), S.TEXTJOIN("/", F.col("p_brand"), F.lit(""), F.col("p_type")).alias("textjoin"),
    )


def fn_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.element_at(F.array(*(F.lit(t) for t in ("1,234.5", "(5)", " 12 ", "1e3", "12d", "abc"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", texts.alias("t")).select("p_partkey", S.VALUE(F.col("t")).alias("value"))


def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.YEAR(day).alias("year"), S.MONTH(day).alias("month"), S.DAY(day).alias("day"), S.WEEKDAY(day).alias("weekday"),
        S.DATE(F.year(day), F.month(day), F.lit(31)).alias("last_day"), coerce.date_to_serial(day.cast("date")).alias("serial"),
        coerce.format_value(day.cast("date"), T.DateType()).alias("shown"), coerce.serial_to_date(F.lit(46262.0)).alias("fixed"),
    )


def fn_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", coerce.number_format(F.col("s_acctbal"), "integer").alias("integer"), coerce.number_format(F.col("s_acctbal"), "decimal2").alias("decimal2"),
        coerce.number_format(F.col("s_suppkey") / 4, "percent").alias("percent"), coerce.format_value(F.col("s_suppkey"), T.LongType()).alias("shown"),
        coerce.format_value(F.col("s_acctbal") > 0, T.BooleanType()).alias("flag"),
    )


def fn_vlookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return lookup.VLOOKUP(customers, "nation", table(spark, sf_dir, "nation"), "n_nationkey", "n_nationkey", "n_name", "nation_name").select("c_custkey", "nation_name")


def fn_vlookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "region").select(F.lower("r_name").alias("name")).unionByName(spark.createDataFrame([("nowhere",)], "name string"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lookup.VLOOKUP(keys, "name", nations.select("r_name", "n_nationkey", "n_name"), "r_name", "n_nationkey", "n_name", "first_nation")


def fn_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("segment")).distinct()
    return lookup.MATCH(segments, "segment", table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", "first_customer")


def fn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.INDEX(table(spark, sf_dir, "part"), "p_partkey", 17, 2)


def fn_hlookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.HLOOKUP(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "S_NAME", 4, "s_suppkey")


QUERIES = {f.__name__: f for f in (
    fn_aggregates, fn_conditional, fn_product, fn_textjoin, fn_status_bar, fn_math, fn_logic, fn_text, fn_value, fn_dates, fn_format,
    fn_vlookup, fn_vlookup_first, fn_match, fn_index, fn_hlookup,
)}

SQL = {
    "fn_aggregates": """
        SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_quantity), 0), 2) AS sum_qty, round(coalesce(avg(l_extendedprice), 0), 2) AS avg_price,
               CAST(count(l_quantity) AS DOUBLE) AS count_qty, CAST(count(l_quantity) AS DOUBLE) AS counta_qty, CAST(count(*) - count(l_quantity) AS DOUBLE) AS blank_qty,
               min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, CAST(median(l_quantity) AS DOUBLE) AS median_qty, round(stddev_samp(l_quantity), 6) AS stdev_qty
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "fn_conditional": """
        SELECT l_linenumber, CAST(count(*) FILTER (WHERE l_quantity > 25) AS DOUBLE) AS many, CAST(count(*) FILTER (WHERE l_quantity <> 1) AS DOUBLE) AS not_one,
               CAST(count(*) FILTER (WHERE upper(l_returnflag) = 'R') AS DOUBLE) AS returned, round(coalesce(sum(l_quantity) FILTER (WHERE l_quantity <= 10), 0), 2) AS small_qty,
               round(coalesce(sum(l_extendedprice) FILTER (WHERE upper(l_returnflag) = 'A'), 0), 2) AS a_price, CAST(0 AS DOUBLE) AS ordered_text
        FROM lineitem GROUP BY l_linenumber""",
    "fn_product": "SELECT l_orderkey, product(l_linenumber) AS product FROM lineitem GROUP BY l_orderkey",
    "fn_textjoin": "SELECT n_regionkey, string_agg(n_name, ' | ' ORDER BY n_nationkey) AS joined, string_agg(n_name, '' ORDER BY n_nationkey) AS concat FROM nation GROUP BY n_regionkey",
    "fn_status_bar": 'SELECT o_orderstatus, round(avg(o_totalprice), 2) AS average, count(o_totalprice) AS "count", round(sum(o_totalprice), 2) AS "sum" FROM orders GROUP BY o_orderstatus',
    "fn_math": """
        SELECT c_custkey, abs(c_acctbal) AS "abs", floor(c_acctbal) AS "int", CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END AS "sqrt", round(c_acctbal * c_acctbal, 2) AS "power",
               CAST(c_custkey % 7 AS DOUBLE) AS "mod", CAST(-(c_custkey % 7) AS DOUBLE) AS mod_negative, CAST(NULL AS DOUBLE) AS mod_zero, round(c_acctbal, 1) AS "round",
               ceil(c_acctbal) + 0.0::DOUBLE AS roundup, floor(c_acctbal) AS rounddown, ceil(c_acctbal / 50) * 50 + 0.0::DOUBLE AS ceiling, floor(c_acctbal / 50) * 50 AS "floor", CAST(0 AS DOUBLE) AS floor_zero,
               CASE WHEN c_nationkey = 0 THEN CAST('inf' AS DOUBLE) ELSE 1.0::DOUBLE / c_nationkey END AS divide
        FROM customer""",
    "fn_logic": """
        SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS "if", c_acctbal > 0 AND c_nationkey > 5 AS "and", c_acctbal < 0 OR c_nationkey = 3 AS "or",
               NOT c_acctbal > 0 AS "not", CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) ELSE -1 END AS iferror, true AS "true", false AS "false"
        FROM customer""",
    "fn_text": r"""
        SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS len, upper(p_name) AS "upper", lower(p_name) AS "lower",
               array_to_string(list_transform(regexp_extract_all(lower(p_name), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') AS proper,
               trim(regexp_replace('  ' || p_name || '   x ', '\s+', ' ', 'g')) AS "trim", left(p_name, 3) AS "left", right(p_name, 4) AS "right", substr(p_name, 2, 3) AS mid,
               substr(p_name, 1, 2) AS mid_low, replace(p_name, 'a', '@') AS substitute, CAST(nullif(instr(p_name, 'e'), 0) AS DOUBLE) AS find, 'ababab' AS rept,
               p_brand || '-' || p_size AS concat, p_brand || '/' || p_type AS textjoin
        FROM part""",
    "fn_value": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1234.5 WHEN 1 THEN -5 WHEN 2 THEN 12 WHEN 3 THEN 1000 END::DOUBLE AS value FROM part",
    "fn_dates": """
        SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS "year", CAST(month(o_orderdate) AS DOUBLE) AS "month", CAST(day(o_orderdate) AS DOUBLE) AS "day",
               CAST(dayofweek(o_orderdate) + 1 AS DOUBLE) AS weekday, CASE WHEN month(o_orderdate) IN (1, 3, 5, 7, 8, 10, 12) THEN last_day(o_orderdate) END AS last_day,
               CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) AS serial, strftime(o_orderdate, '%d/%m/%Y') AS shown, DATE '2026-08-28' AS fixed
        FROM orders""",
    "fn_format": """
        SELECT s_suppkey, replace(format('{:,}', CAST(round_even(s_acctbal, 0) AS BIGINT)), ',', '.') AS integer,
               translate(format('{:,.2f}', s_acctbal), ',.', '.,') AS decimal2,
               format('{:.1f}%', s_suppkey / 4.0 * 100) AS percent, CAST(s_suppkey AS VARCHAR) AS shown, upper(CAST(s_acctbal > 0 AS VARCHAR)) AS flag
        FROM supplier""",
    "fn_vlookup": "SELECT c_custkey, n_name AS nation_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "fn_vlookup_first": """
        SELECT lower(r_name) AS name, arg_min(n_name, n_nationkey) AS first_nation FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name
        UNION ALL SELECT 'nowhere', NULL""",
    "fn_match": "SELECT lower(c_mktsegment) AS segment, min(c_custkey) AS first_customer FROM customer GROUP BY 1",
    "fn_index": "SELECT p_name AS value FROM part ORDER BY p_partkey LIMIT 1 OFFSET 16",
    "fn_hlookup": "SELECT s_name AS found FROM supplier ORDER BY s_suppkey LIMIT 1 OFFSET 2",
}
