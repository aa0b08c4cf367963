"""Spreadsheet functions: the sheet of goods and edge cases."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import aggregates as A
from gridloom.functions import catalog, coerce, lookup
from gridloom.functions import scalars as S


@pytest.fixture(scope="module")
def goods(spark):
    return spark.createDataFrame([(1, "SP001", "Bàn phím", 12.0), (2, "SP002", "Chuột", 34.0), (3, "SP003", "Màn hình", 7.0), (4, "SP004", "Loa", 50.0)], "row int, code string, name string, qty double")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_aggregates(goods):
    q = F.col("qty")
    r = goods.agg(A.SUM(q), A.AVERAGE(q), A.MIN(q), A.MAX(q), A.MEDIAN(q), A.COUNTIF(q, ">20"), A.SUMIF(q, ">20"), A.COUNTA(F.col("code")), A.COUNT(q), A.PRODUCT(q)).first()
    assert list(r) == [103, 25.75, 7, 50, 23, 2, 84, 4, 4, 12 * 34 * 7 * 50]
    assert goods.agg(A.STDEV(q)).first()[0] == pytest.approx(19.9729, abs=1e-3)
    none = goods.where("false").agg(A.SUM(q), A.AVERAGE(q), A.MEDIAN(q), A.STDEV(q), A.PRODUCT(q)).first()
    assert list(none) == [0, 0, 0, None, 0]
    assert goods.agg(A.CONCAT(F.col("name"), F.col("row")), A.TEXTJOIN(" | ", F.col("name"), F.col("row"))).first()[1] == "Bàn phím | Chuột | Màn hình | Loa"


def test_math(spark):
    for column, want in [
        (S.ABS(F.lit(-5)), 5), (S.ROUND(F.lit(3.14159), 2), 3.14), (S.ROUNDUP(F.lit(3.1)), 4), (S.ROUNDDOWN(F.lit(3.9)), 3), (S.MOD(F.lit(10), F.lit(3)), 1),
        (S.MOD(F.lit(-7), F.lit(3)), -1), (S.MOD(F.lit(1), F.lit(0)), None), (S.POWER(F.lit(2), 3), 8), (S.SQRT(F.lit(16)), 4), (S.SQRT(F.lit(-1)), None), (S.INT(F.lit(2.9)), 2),
        (S.INT(F.lit(-2.1)), -3), (S.CEILING(F.lit(7), 5), 10), (S.FLOOR(F.lit(7), 5), 5), (S.FLOOR(F.lit(7), 0), 0), (S.ROUND(F.lit(-2.5)), -3), (S.DIVIDE(F.lit(1), F.lit(0)), float("inf")),
    ]:
        assert one(spark, column) == want


def test_text_and_dates(spark):
    name = F.lit("Màn hình")
    for column, want in [
        (S.LEN(name), 8), (S.UPPER(name), "MÀN HÌNH"), (S.LEFT(name, 3), "Màn"), (S.RIGHT(name, 4), "hình"), (S.MID(name, 2, 2), "àn"), (S.MID(name, 20, 2), ""),
        (S.CONCAT(F.lit("Bàn phím"), F.lit("-"), F.lit("Chuột")), "Bàn phím-Chuột"), (S.TEXTJOIN(" | ", F.lit("a"), F.lit(""), F.lit("b")), "a | b"),
        (S.SUBSTITUTE(name, "hình", "ảnh"), "Màn ảnh"), (S.TRIM(F.lit("  xin   chao  ")), "xin chao"), (S.PROPER(F.lit("hELLO wORLD-foo")), "Hello World-Foo"), (S.FIND("h", name), 5),
        (S.FIND("z", name), None), (S.REPT(F.lit("ab"), 2), "abab"), (S.VALUE(F.lit("1,234.5")), 1234.5), (S.VALUE(F.lit("(5)")), -5), (S.VALUE(F.lit("12d")), None),
        (S.DATE(F.lit(2026), F.lit(8), F.lit(28)), datetime.date(2026, 8, 28)), (S.DATE(F.lit(2026), F.lit(2), F.lit(30)), None), (S.WEEKDAY(F.lit("2026-08-28").cast("date")), 6),
        (coerce.format_value(F.lit("2026-08-28").cast("date"), T.DateType()), "28/08/2026"), (coerce.format_value(F.lit(42.0), T.DoubleType()), "42"), (coerce.format_value(F.lit(True), T.BooleanType()), "TRUE"),
        (coerce.number_format(F.lit(1234567.891), "decimal2"), "1.234.567,89"), (coerce.number_format(F.lit(1234.5), "thousands"), "1.234,5"), (coerce.number_format(F.lit(1000.0), "thousands"), "1.000"),
        (coerce.number_format(F.lit(0.123), "percent"), "12.3%"), (coerce.number_format(F.lit(50000.0), "currency"), "50.000 ₫"), (coerce.number_format(F.lit(46262.0), "date"), "28/08/2026"),
    ]:
        assert one(spark, column) == want


def test_whole_zero_has_no_sign(spark):
    for number, code, want in [
        (-0.3, "integer", "0"), (-0.5, "integer", "0"), (-0.51, "integer", "-1"), (-0.0, "integer", "0"), (-0.3, "currency", "0 ₫"), (-0.0, "thousands", "0"), (-0.004, "thousands", "0"),
        (-0.04, "thousands", "-0,04"), (-0.3, "decimal2", "-0,30"), (-1000.2, "integer", "-1.000"),
    ]:
        assert one(spark, coerce.number_format(F.lit(number), code)) == want
    assert one(spark, coerce.number_format(F.lit(None).cast("double"), "integer")) is None


def test_logic(spark, goods):
    q = F.col("qty")
    at = lambda row, c: goods.where(F.col("row") == row).select(c.alias("x")).first().x
    assert at(4, S.IF(q > 20, F.lit("Đạt"), F.lit("Chưa đạt"))) == "Đạt" and at(3, S.NOT(q > 20)) is True
    assert one(spark, S.AND()) is False and one(spark, S.OR()) is False and one(spark, S.AND(F.lit(None).cast("boolean"))) is False
    assert one(spark, S.IFERROR(F.lit("#N/A"), F.lit("none"))) == "none" and one(spark, S.IFERROR(S.SQRT(F.lit(-1)), F.lit(0.0))) == 0


def test_lookups(spark, goods):
    asked = spark.createDataFrame([("sp002",), ("KHONGCO",)], "code string")
    found = {r.code: (r.name, r.place) for r in lookup.MATCH(lookup.VLOOKUP(asked, "code", goods, "code", "row", "name", "name"), "code", goods, "code", "row").collect()}
    assert found == {"sp002": ("Chuột", 2), "KHONGCO": (None, None)}
    assert lookup.INDEX(goods.select("code", "name", "qty"), "code", 3, 2).first().value == "Màn hình" and lookup.INDEX(goods, "row", 9, 2).count() == 0
    assert lookup.HLOOKUP(goods, "QTY", 3, "row").first().found == 34
    with pytest.raises(ValueError, match="#REF!"):
        lookup.INDEX(goods, "row", 1, 9)


def test_catalogue():
    assert len(catalog.CATALOGUE) == 54 and catalog.find("avg").name == "AVERAGE" and catalog.find("NOSUCH") is None
    for prefix, want in (("SU", "SUM"), ("su", "SUM"), ("CO", "COUNT"), ("VL", "VLOOKUP"), ("AVER", "AVERAGE")):
        assert want in catalog.suggest(prefix)


def test_criteria(spark):
    values = spark.createDataFrame([("a",), ("A",), ("b",), ("12",), (None,)], "v string")
    count = lambda c: values.where(coerce.criteria(F.col("v"), c, T.StringType())).count()
    assert [count("a"), count("<>a"), count(">5"), count(""), count(">a"), count("12")] == [2, 3, 1, 0, 0, 1]


def test_criteria_and_truth(spark):
    text = T.StringType()
    rows = spark.createDataFrame([("5",), ("6",), ("x",), (" 5 ",), (None,)], "t string")
    for condition, want in [("!=5", 3), ("<>5", 3), ('="5"', 2), (" = 5", 2), ("x", 1), ('"X"', 1), (">5", 1), (">x", 0), ("", 0), ("  ", 0), (5, 2)]:
        assert rows.agg(A.COUNTIF(F.col("t"), condition, text)).first()[0] == want, condition
    assert rows.agg(A.SUM(F.col("t")), A.AVERAGE(F.col("t")), A.MAX(F.col("t")), A.STDEV(F.col("t"))).first()[:3] == (16, 16 / 3, 6)
    for value, want in [(F.lit("6"), True), (F.lit("FALSE"), True), (F.lit("#N/A"), True), (F.lit(0), False), (F.lit(0.5), True), (F.lit(None), False), (F.lit(True), True), (F.lit(False), False), (F.current_date(), True)]:
        assert one(spark, S.truth(value)) is want
    assert one(spark, S.IF(F.lit("6"), F.lit("yes"), F.lit("no"))) == "yes"


def test_dates_in_text(spark):
    text = T.StringType()
    for shown in ("28/08/2026", "28/8/2026 14:05", "2026-08-28", "46262", "8/28/2026"):
        assert [one(spark, f(F.lit(shown), text)) for f in (S.YEAR, S.MONTH, S.DAY, S.WEEKDAY)] == [2026, 8, 28, 6]
    assert one(spark, S.YEAR(F.lit("soon"), text)) is None and one(spark, S.DAY(F.lit(46262.5), T.DoubleType())) == 28


def test_lookups_count_rows_from_the_header(spark, goods):
    assert [lookup.HLOOKUP(goods, "NAME", k, "row").first()[0] for k in (1, 2, 5)] == ["name", "Bàn phím", "Loa"]
    assert lookup.HLOOKUP(goods, "none", 2, "row").first()[0] is None and lookup.HLOOKUP(goods, "name", 9, "row").count() == 0
    many = spark.range(30_000).select((F.col("id") * 7919 % 30_011).alias("k"), F.col("id").alias("v"))
    wanted = {n: sorted((k * 7919 % 30_011, k) for k in range(30_000))[n - 1][1] for n in (1, 777, 29_000)}
    assert {n: lookup.INDEX(many, "k", n, 2).first()[0] for n in wanted} == wanted


def test_suggestions_look_into_descriptions():
    assert [catalog.suggest(p)[0] for p in ("SU", "su", "CO", "VL", "AVER")] == ["SUM", "SUM", "COUNT", "VLOOKUP", "AVERAGE"]
    assert catalog.suggest("remainder") == ["MOD"] and catalog.suggest(" ") == sorted(catalog.CATALOGUE)[:12] and catalog.suggest("nothing like it") == []
    assert all(f.description for f in catalog.CATALOGUE.values())
