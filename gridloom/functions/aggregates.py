"""Aggregate spreadsheet functions as aggregate Column builders; they work in groupBy().agg() and over windows.

Values that are no numbers are skipped; an empty range gives 0 where the spreadsheet does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.coerce import criteria, format_value, to_number


def SUM(x: Column, kind: T.DataType | None = None) -> Column:
    return F.coalesce(F.sum(to_number(x, kind)), F.lit(0.0))


def AVERAGE(x: Column, kind: T.DataType | None = None) -> Column:
    return F.coalesce(F.avg(to_number(x, kind)), F.lit(0.0))


def COUNT(x: Column, kind: T.DataType | None = None) -> Column:
    """Native numbers only: text, booleans and dates don't count."""
    return F.lit(0.0) if kind is not None and not isinstance(kind, T.NumericType) else F.count(x).cast("double")


def COUNTA(x: Column, kind: T.DataType | None = None) -> Column:
    return F.count_if(format_value(x, kind) != "").cast("double")


def COUNTBLANK(x: Column, kind: T.DataType | None = None) -> Column:
    return F.count_if(format_value(x, kind) == "").cast("double")


def MIN(x: Column, kind: T.DataType | None = None) -> Column:
    return F.coalesce(F.min(to_number(x, kind)), F.lit(0.0))


def MAX(x: Column, kind: T.DataType | None = None) -> Column:
    return F.coalesce(F.max(to_number(x, kind)), F.lit(0.0))


def PRODUCT(x: Column, kind: T.DataType | None = None) -> Column:
    return F.coalesce(F.product(to_number(x, kind)), F.lit(0.0))


def MEDIAN(x: Column, kind: T.DataType | None = None) -> Column:
    """Exact; the mean of the middle two."""
    return F.coalesce(F.median(to_number(x, kind)), F.lit(0.0))


def STDEV(x: Column, kind: T.DataType | None = None) -> Column:
    """Of a sample; null (#DIV/0!) for fewer than two numbers."""
    return F.stddev_samp(to_number(x, kind))


def COUNTIF(x: Column, condition: str | float, kind: T.DataType | None = None) -> Column:
    return F.count_if(criteria(x, condition, kind)).cast("double")


def SUMIF(x: Column, condition: str | float, values: Column | None = None, kind: T.DataType | None = None) -> Column:
    summed = to_number(x, kind) if values is None else to_number(values)
    return F.coalesce(F.sum(F.when(criteria(x, condition, kind), summed)), F.lit(0.0))


def _in_order(x: Column, order: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), x.cast("string").alias("x")))), lambda s: s["x"])


def CONCAT(x: Column, order: Column) -> Column:
    """A range's texts in order, as one text; a group's texts meet in one row."""
    return F.array_join(_in_order(x, order), "")


def TEXTJOIN(separator: str, x: Column, order: Column) -> Column:
    return F.array_join(F.filter(_in_order(x, order), lambda t: t != ""), separator)


def status_bar(x: Column) -> list[Column]:
    """average, count and sum of a selection; booleans and dates don't count."""
    return [AVERAGE(x).alias("average"), F.count(x).alias("count"), SUM(x).alias("sum")]
