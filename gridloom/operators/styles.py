"""Cell styles: the table of distinct styles and the number formats' patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: a number format's code and its pattern in a workbook
PATTERNS = {
    "integer": "#,##0",
    "decimal2": "#,##0.00",
    "thousands": "#,##0.##",
    "currency": '#,##0\\ "₫"',
    "percent": "0.0%",
    "date": "dd/mm/yyyy",
    "scientific": "0.000E+00",
}


def style_table(cells: DataFrame, style: list[str]) -> DataFrame:
    """A row per distinct style with style_id; the style of nulls is 0. Distinct styles are few, whatever the cells."""
    distinct = cells.select(*style).distinct()
    plain = F.lit(True)
    for c in style:
        plain = plain & F.col(c).isNull()
    styled = distinct.where(~plain).withColumn("style_id", F.row_number().over(Window.orderBy(*style)))
    nothing = distinct.sparkSession.createDataFrame([(None,) * len(style) + (0,)], styled.schema)
    return nothing.unionByName(styled)


def with_style_ids(cells: DataFrame, style: list[str]) -> DataFrame:
    table = style_table(cells, style).select(*(F.col(c).alias(f"{c}_s") for c in style), "style_id")
    on = F.lit(True)
    for c in style:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_s"))
    return cells.join(table, on).drop(*(f"{c}_s" for c in style))


def pattern_of(code: Column) -> Column:
    pairs = [F.lit(x) for pair in PATTERNS.items() for x in pair]
    return F.create_map(*pairs)[F.lower(code)]


def code_of(pattern: Column) -> Column:
    """The code of exactly this pattern; null for any other."""
    pairs = [F.lit(x) for code, p in PATTERNS.items() for x in (p, code)]
    return F.create_map(*pairs)[pattern]


# fixed values: words of the labels of number formats, in the order in which they are looked for, and the code that each stands for
_LABELS = (
    (("chung", "general"), None), (("tiền", "currency", "₫"), "currency"), (("phần trăm", "percent", "%"), "percent"), (("nghìn", "thousand"), "thousands"), (("ngày", "date"), "date"),
    (("khoa học", "scientific"), "scientific"), (("số nguyên", "integer"), "integer"), (("thập phân", "decimal"), "decimal2"),
)


def code_of_label(label: Column) -> Column:
    """The format code that a list's label, such as "Tiền tệ (₫)", stands for; null for the general format and any other label."""
    lower, out = F.lower(label), None
    for words, code in _LABELS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lower, F.lit(word))
        out = F.when(hit, F.lit(code)) if out is None else out.when(hit, F.lit(code))
    return out
