"""Scalar spreadsheet functions as Column builders.

A function whose argument can be wrong (a root of a negative number, an invalid date) gives null in the value;
`error` beside it names the error, and IFERROR takes either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.coerce import date_of, text_to_number, to_number

ERRORS = {"SQRT": "#NUM!", "MOD": "#DIV/0!", "DATE": "#VALUE!", "FIND": "#VALUE!", "VALUE": "#VALUE!", "STDEV": "#DIV/0!", "VLOOKUP": "#N/A", "MATCH": "#N/A"}


# Math


def ABS(x: Column) -> Column:
    return F.abs(x.cast("double"))


def INT(x: Column) -> Column:
    return F.floor(x.cast("double")).cast("double")


def SQRT(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x.cast("double")))


def POWER(x: Column, exponent: Column | float = 1.0) -> Column:
    return F.pow(x.cast("double"), exponent)


def MOD(x: Column, divisor: Column) -> Column:
    """The remainder has the dividend's sign; a zero divisor is an error."""
    return F.try_mod(x.cast("double"), divisor.cast("double"))


def DIVIDE(x: Column, y: Column) -> Column:
    """The operator /: by zero it is infinite with the sign of the dividend; what is no number counts as 0 on the left and as 1 on the right."""
    a, b = F.coalesce(to_number(x), F.lit(0.0)), F.coalesce(to_number(y), F.lit(1.0))
    return F.when(b == 0, F.when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(a, b))


def ADD(x: Column, y: Column) -> Column:
    """The operator +: what is no number counts as 0."""
    return F.coalesce(to_number(x), F.lit(0.0)) + F.coalesce(to_number(y), F.lit(0.0))


def SUBTRACT(x: Column, y: Column) -> Column:
    """The operator -: what is no number counts as 0."""
    return F.coalesce(to_number(x), F.lit(0.0)) - F.coalesce(to_number(y), F.lit(0.0))


def MULTIPLY(x: Column, y: Column) -> Column:
    """The operator *: what is no number counts as 0 on the left and as 1 on the right."""
    return F.coalesce(to_number(x), F.lit(0.0)) * F.coalesce(to_number(y), F.lit(1.0))


def _whole(n: Column | float, least: int, most: int | None = None, missing: int = 0) -> Column:
    """An argument as a whole number within bounds, its fraction cut off; missing where it is no number."""
    value = F.coalesce(to_number(n).try_cast("int"), F.lit(missing)) if isinstance(n, Column) else F.lit(int(n))
    return F.greatest(F.lit(least), value if most is None else F.least(F.lit(most), value))


def _text(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ROUND(x: Column, digits: Column | int = 0) -> Column:
    """Halves go away from zero; digits from 0 to 15."""
    x = x.cast("double")
    if not isinstance(digits, Column):
        return F.round(x, min(max(digits, 0), 15))
    n, out = _whole(digits, 0, 15), F.round(x, 15)
    for k in range(15):
        out = F.when(n == k, F.round(x, k)).otherwise(out)
    return out


def ROUNDUP(x: Column, digits: Column | int = 0) -> Column:
    scale = F.pow(F.lit(10.0), _whole(digits, 0, 15))
    return F.ceil(x.cast("double") * scale).cast("double") / scale


def ROUNDDOWN(x: Column, digits: Column | int = 0) -> Column:
    scale = F.pow(F.lit(10.0), _whole(digits, 0, 15))
    return F.floor(x.cast("double") * scale).cast("double") / scale


def _steps(x: Column, step: Column | float, whole: Callable[[Column], Column]) -> Column:
    step = F.coalesce(to_number(step), F.lit(1.0)) if isinstance(step, Column) else F.lit(float(step))
    return F.when(step == 0, F.lit(0.0)).otherwise(whole(F.try_divide(x.cast("double"), step)).cast("double") * step)


def CEILING(x: Column, step: Column | float = 1.0) -> Column:
    return _steps(x, step, F.ceil)


def FLOOR(x: Column, step: Column | float = 1.0) -> Column:
    return _steps(x, step, F.floor)


# Logic: conditions are two-valued, null counts as false


def truth(condition: Column) -> Column:
    """A boolean itself; a number unless it is 0; any other value, error texts too, unless it is null."""
    kind, text = F.typeof(condition), condition.cast("string")  # the type is known when the plan is made, and one branch stays
    number = kind.isin("tinyint", "smallint", "int", "bigint", "float", "double") | kind.startswith("decimal")
    value = F.when(kind == "boolean", text == "true").when(number, text.try_cast("double") != 0).otherwise(condition.isNotNull())
    return F.coalesce(value, F.lit(False))


def IF(condition: Column, then: Column, otherwise: Column | None = None) -> Column:
    return F.when(truth(condition), then).otherwise(F.lit(False) if otherwise is None else otherwise)


def AND(*conditions: Column) -> Column:
    out = F.lit(bool(conditions))
    for c in conditions:
        out = out & truth(c)
    return out


def OR(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | truth(c)
    return out


def NOT(condition: Column) -> Column:
    return ~truth(condition)


def TRUE() -> Column:
    return F.lit(True)


def FALSE() -> Column:
    return F.lit(False)


def IFERROR(value: Column, fallback: Column) -> Column:
    """fallback where value is an error: null here, or a text that starts with #."""
    return F.when(value.isNull() | value.cast("string").startswith("#"), fallback).otherwise(value)


# Text


def LEN(text: Column) -> Column:
    return F.length(text).cast("double")


def UPPER(text: Column) -> Column:
    return F.upper(text)


def LOWER(text: Column) -> Column:
    return F.lower(text)


def PROPER(text: Column) -> Column:
    """Each run of letters starts with a capital."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), "")


def TRIM(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def LEFT(text: Column, n: Column | int = 1) -> Column:
    return F.left(text, _whole(n, 0, missing=1))


def RIGHT(text: Column, n: Column | int = 1) -> Column:
    return F.right(text, _whole(n, 0, missing=1))


def MID(text: Column, start: Column | int, n: Column | int) -> Column:
    return F.substring(text, _whole(start, 1, missing=1), _whole(n, 0))


def SUBSTITUTE(text: Column, old: Column | str, new: Column | str) -> Column:
    old = _text(old)
    return F.when(old == "", text).otherwise(F.replace(text, old, _text(new)))


def FIND(needle: Column | str, text: Column) -> Column:
    at = F.position(_text(needle), text)
    return F.when(at > 0, at.cast("double"))


def REPT(text: Column, times: Column | int) -> Column:
    return F.repeat(text, _whole(times, 0, 10_000))


def VALUE(text: Column) -> Column:
    return text_to_number(text)


def CONCAT(*texts: Column) -> Column:
    return F.concat(*(F.coalesce(t.cast("string"), F.lit("")) for t in texts))


def TEXTJOIN(separator: str, *texts: Column) -> Column:
    """Null and empty texts are left out."""
    return F.array_join(F.filter(F.array(*(t.cast("string") for t in texts)), lambda t: t != ""), separator)


# Dates


def TODAY() -> Column:
    return F.current_date()


def NOW() -> Column:
    return F.localtimestamp()


def DATE(year: Column, month: Column, day: Column) -> Column:
    """Null where there is no such day; months and days don't overflow."""
    return F.to_date(F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")))


def YEAR(day: Column, kind: T.DataType | None = None) -> Column:
    """Of a date; with a kind, of a serial number or of text too. So are MONTH, DAY and WEEKDAY."""
    return F.year(date_of(day, kind)).cast("double")


def MONTH(day: Column, kind: T.DataType | None = None) -> Column:
    return F.month(date_of(day, kind)).cast("double")


def DAY(day: Column, kind: T.DataType | None = None) -> Column:
    return F.dayofmonth(date_of(day, kind)).cast("double")


def WEEKDAY(day: Column, kind: T.DataType | None = None) -> Column:
    """Sunday is 1."""
    return F.dayofweek(date_of(day, kind)).cast("double")
