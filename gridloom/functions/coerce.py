"""How cell values become numbers and display text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Day 0 of serial dates.
EPOCH = "1899-12-30"
#: Forms of dates in text, in the order in which they are tried; ISO forms come between the first four and the last.
_DATE_FORMS = ("d/M/yyyy", "d/M/yyyy HH:mm", "d/M/yyyy HH:mm:ss", "d-M-yyyy")
_LAST_FORM = "M/d/yyyy"
#: Numbers this close are equal.
EPSILON = 1e-7


def text_to_number(text: Column) -> Column:
    """A number with optional thousands commas, an exponent, or parentheses for negative; else null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), ",", ""), r"^\((.*)\)$", "-$1")
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def date_to_serial(day: Column) -> Column:
    """Days since the epoch, the time of day as a fraction."""
    stamp = day.cast("timestamp_ntz")
    seconds = F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)
    return F.datediff(stamp.cast("date"), F.lit(EPOCH).cast("date")).cast("double") + seconds / 86400.0


def serial_to_date(serial: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(serial).cast("int"))


def date_of(value: Column, kind: T.DataType | None = None) -> Column:
    """A timestamp of a date, of a serial number, or of text in one of the usual forms; else null."""
    if isinstance(kind, T.NumericType):
        number = value.cast("double")
        day = serial_to_date(number).cast("timestamp_ntz")
        return day + F.make_dt_interval(secs=F.round((number - F.floor(number)) * 86400).cast("decimal(18,6)"))
    if isinstance(kind, T.StringType):
        text = F.trim(value)
        parsed = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in _DATE_FORMS]
        iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp_ntz"))
        return F.coalesce(*parsed, iso, F.try_to_timestamp(text, F.lit(_LAST_FORM)).cast("timestamp_ntz"), date_of(text_to_number(text), T.DoubleType()))
    return value.cast("timestamp_ntz")


def to_number(value: Column, kind: T.DataType | None = None) -> Column:
    """The formula coercion: booleans are 1 or 0, dates are serials, text is parsed, anything else is null.

    Without a kind, value may be a number, a boolean or text.
    """
    if isinstance(kind, T.StringType):
        return text_to_number(value)
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return date_to_serial(value)
    if isinstance(kind, T.NumericType | T.BooleanType):
        return value.cast("double")
    # the type is known when the plan is made, and one branch stays
    return F.when(F.typeof(value) == "string", text_to_number(value.cast("string"))).otherwise(value.try_cast("double"))


def format_value(value: Column, kind: T.DataType | None = None) -> Column:
    """Display text: null is empty, whole numbers have no point, dates are dd/MM/yyyy, booleans upper case."""
    if isinstance(kind, T.BooleanType):
        text = F.upper(value.cast("string"))
    elif isinstance(kind, T.DateType):
        text = F.date_format(value, "dd/MM/yyyy")
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        midnight = (F.hour(value) == 0) & (F.minute(value) == 0)
        text = F.when(midnight, F.date_format(value, "dd/MM/yyyy")).otherwise(F.date_format(value, "dd/MM/yyyy HH:mm"))
    elif isinstance(kind, T.NumericType):
        number = value.cast("double")
        text = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def number_format(value: Column, code: str) -> Column:
    """Display by format code; the Vietnamese forms use a point for thousands and a comma for decimals."""
    number = value.cast("double")
    swapped = lambda digits: F.translate(F.format_number(number, digits), ",.", ".,")
    unsigned = lambda text: F.when(text == "-0", "0").otherwise(text)  # noqa: E731  what rounds to a whole 0 has no sign
    forms = {
        "currency": lambda: F.concat(unsigned(swapped(0)), F.lit(" ₫")),
        "percent": lambda: F.format_string("%.1f%%", number * 100),
        "integer": lambda: unsigned(swapped(0)),
        "decimal2": lambda: swapped(2),
        "date": lambda: F.date_format(serial_to_date(number), "dd/MM/yyyy"),
    }
    if code == "thousands":  # at most two decimals, none that are zero
        whole = number == F.floor(number)
        return unsigned(F.when(whole, swapped(0)).otherwise(F.regexp_replace(swapped(2), "(,0+|(?<=,\\d)0)$", "")))
    return forms[code]()


def compare(left: Column, operator: str, right: Column, left_kind: T.DataType | None = None, right_kind: T.DataType | None = None) -> Column:
    """left operator right: as numbers if both are, equal within EPSILON; else equality of texts in any case. Text has no order."""
    a, b = to_number(left, left_kind), to_number(right, right_kind)
    near = F.abs(a - b) < EPSILON
    numbers = {"=": near, "==": near, "<>": ~near, "!=": ~near, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[operator]
    same = F.upper(format_value(left, left_kind)) == F.upper(F.btrim(format_value(right, right_kind), F.lit("\"'")))
    texts = same if operator in ("=", "==") else ~same if operator in ("<>", "!=") else F.lit(False)
    return F.when(a.isNotNull() & b.isNotNull(), numbers).otherwise(texts)


def criteria(value: Column, condition: str | float, kind: T.DataType | None = None) -> Column:
    """True where value meets a condition such as ">20", "<>x", "!=5" or "SP001"; text compares case-insensitively.

    Blanks around a condition, and quotes around what it compares with, don't count. An empty condition matches nothing;
    text under an ordering operator matches nothing.
    """
    operator, operand = re.fullmatch(r"(>=|<=|<>|!=|>|<|=)?\s*(.*)", str(condition).strip(), re.S).groups()
    operand = operand.strip().strip('"')
    if not str(condition).strip():
        return F.lit(False)
    unequal = operator in ("<>", "!=")
    number = to_number(value, kind)
    plain = re.sub(r"^\((.*)\)$", r"-\1", operand.replace(",", ""))
    if not re.fullmatch(_NUMBER, plain, re.ASCII):  # as `text_to_number` reads a cell
        equal = F.upper(format_value(value, kind)) == operand.upper()
        return ~equal if unequal else equal if operator in (None, "=") else F.lit(False)
    wanted = float(plain)
    near = F.abs(number - wanted) < EPSILON
    tests = {None: near, "=": near, "<>": ~near, "!=": ~near, ">": number > wanted, "<": number < wanted, ">=": number >= wanted, "<=": number <= wanted}
    return F.coalesce(tests[operator], F.lit(unequal))
