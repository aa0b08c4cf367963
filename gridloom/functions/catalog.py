"""The catalogue of spreadsheet functions: name, category, arguments and what builds it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from gridloom.functions import aggregates, lookup, scalars

# fixed values: the catalogue's functions by category, with their arguments
_ENTRIES = {
    "math": "SUM num1;num2;... | PRODUCT num1;num2;... | ABS num | ROUND num;digits | ROUNDUP num;digits | ROUNDDOWN num;digits | INT num | MOD num;divisor | POWER num;exponent | SQRT num | CEILING num;multiple | FLOOR num;multiple",
    "statistics": "AVERAGE num1;num2;... | COUNT range | COUNTA range | COUNTBLANK range | COUNTIF range;condition | SUMIF range;condition;[sum_range] | MIN num1;num2;... | MAX num1;num2;... | MEDIAN num1;num2;... | STDEV num1;num2;...",
    "logic": "IF condition;if_true;if_false | AND cond1;cond2;... | OR cond1;cond2;... | NOT condition | IFERROR expr;if_error | TRUE  | FALSE ",
    "text": "CONCAT text1;text2;... | LEFT text;n_chars | RIGHT text;n_chars | MID text;start;n_chars | LEN text | UPPER text | LOWER text | PROPER text | TRIM text | SUBSTITUTE text;old;new | FIND needle;text | REPT text;times | TEXTJOIN separator;range | VALUE text",
    "date": "TODAY  | NOW  | DATE year;month;day | YEAR day | MONTH day | DAY day | WEEKDAY day",
    "lookup": "VLOOKUP value;range;col | HLOOKUP value;range;row | INDEX range;row;[col] | MATCH value;range",
}
_DESCRIPTIONS = {
    "SUM": "adds numbers", "PRODUCT": "multiplies numbers", "ABS": "a number without its sign", "ROUND": "rounds, halves away from zero", "ROUNDUP": "rounds towards plus infinity",
    "ROUNDDOWN": "rounds towards minus infinity", "INT": "the whole number below", "MOD": "the remainder of a division", "POWER": "a number to an exponent", "SQRT": "the square root",
    "CEILING": "the next multiple above", "FLOOR": "the next multiple below", "AVERAGE": "the mean of numbers", "COUNT": "how many numbers there are", "COUNTA": "how many cells are filled",
    "COUNTBLANK": "how many cells are blank", "COUNTIF": "how many cells meet a condition", "SUMIF": "adds where a condition is met", "MIN": "the smallest number", "MAX": "the largest number",
    "MEDIAN": "the middle number", "STDEV": "the standard deviation of a sample", "IF": "one value or another by a condition", "AND": "true if all conditions are", "OR": "true if any condition is",
    "NOT": "the opposite of a condition", "IFERROR": "another value in place of an error", "TRUE": "the value true", "FALSE": "the value false", "CONCAT": "joins texts", "LEFT": "the first characters of a text",
    "RIGHT": "the last characters of a text", "MID": "characters from the middle of a text", "LEN": "the length of a text", "UPPER": "a text in capitals", "LOWER": "a text in small letters",
    "PROPER": "a capital at the start of each word", "TRIM": "a text without needless spaces", "SUBSTITUTE": "replaces a part of a text", "FIND": "the place of a text within another", "REPT": "repeats a text",
    "TEXTJOIN": "joins texts with a separator", "VALUE": "the number that a text shows", "TODAY": "the current date", "NOW": "the current date and time", "DATE": "a date of year, month and day",
    "YEAR": "the year of a date", "MONTH": "the month of a date", "DAY": "the day of a date's month", "WEEKDAY": "the day of the week, Sunday first", "VLOOKUP": "looks a value up in the first column",
    "HLOOKUP": "looks a value up in the first row", "INDEX": "the cell at a row and column", "MATCH": "the place of a value in a range",
}
ALIASES = {"AVG": "AVERAGE", "CONCATENATE": "CONCAT"}
SUGGESTIONS = 12


@dataclass(frozen=True)
class Function:
    name: str
    category: str
    arguments: tuple[str, ...]
    build: Callable
    description: str = ""


def _catalogue() -> dict[str, Function]:
    out = {}
    for category, entries in _ENTRIES.items():
        for entry in entries.split(" | "):
            name, _, arguments = entry.partition(" ")
            home = next(m for m in (scalars, aggregates, lookup) if hasattr(m, name))
            out[name] = Function(name, category, tuple(a for a in arguments.strip().split(";") if a), getattr(home, name), _DESCRIPTIONS[name])
    return out


CATALOGUE: dict[str, Function] = _catalogue()


def find(name: str) -> Function | None:
    name = name.upper()
    return CATALOGUE.get(ALIASES.get(name, name))


def register(name: str, category: str, arguments: tuple[str, ...], build: Callable, description: str = "") -> None:
    """Add a function of your own."""
    CATALOGUE[name.upper()] = Function(name.upper(), category, arguments, build, description)


def suggest(prefix: str) -> list[str]:
    """Names that start with prefix, shortest first, then those that contain it in the name or the description; all names for a blank one."""
    prefix = prefix.strip().upper()
    if not prefix:
        return sorted(CATALOGUE)[:SUGGESTIONS]
    starts = sorted((n for n in CATALOGUE if n.startswith(prefix)), key=lambda n: (len(n), n))
    others = sorted(n for n, f in CATALOGUE.items() if n not in starts and (prefix in n or prefix in f.description.upper()))
    return (starts + others)[:SUGGESTIONS]
