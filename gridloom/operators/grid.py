"""Grid operators over sparse cells: a long table with a row per non-empty cell.

cells: sheet, row, col (from 1), text (display string), num (its number, or null). Wide tables enter by
`to_cells` and leave by `to_table`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.coerce import format_value, text_to_number
from gridloom.operators.rounds import numbered

CELLS = ["sheet", "row", "col", "text", "num"]


def col_letters(col: Column) -> Column:
    """1 is A, 27 is AA, 18279 is AAAA; every bigint, with 14 letters at most."""
    left, letters = F.greatest(col.cast("bigint"), F.lit(0).cast("bigint")), []
    for _ in range(14):
        letters.append(F.when(left > 0, F.chr(F.lit(65) + F.pmod(left - 1, F.lit(26)).cast("int"))).otherwise(""))
        left = F.call_function("div", left - 1, F.lit(26))  # whole numbers: as doubles, those beyond 2^53 would lose digits
    return F.concat(*reversed(letters))


def col_number(letters: Column) -> Column:
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("bigint"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + (F.ascii(c) - 64)))


def address(row: Column, col: Column) -> Column:
    return F.concat(col_letters(col), row.cast("string"))


def parse_address(text: Column) -> tuple[Column, Column]:
    """(row, col) of A1-style text; null where it is none."""
    good = text.rlike(r"^[A-Za-z]+\d+$")
    return F.when(good, F.regexp_extract(text, r"\d+$", 0).cast("int")), F.when(good, col_number(F.regexp_extract(text, r"^[A-Za-z]+", 0)))


def to_cells(table: DataFrame, row: str, columns: list[str], sheet: str = "Sheet1") -> DataFrame:
    """A cell per value of columns; `row` holds the row number. Empty values make no cell."""
    values = F.array(*(F.struct(F.lit(k + 1).alias("col"), format_value(F.col(c), table.schema[c].dataType).alias("text")) for k, c in enumerate(columns)))
    cells = table.select(F.lit(sheet).alias("sheet"), F.col(row).cast("bigint").alias("row"), F.explode(values).alias("c"))
    return cells.where("c.text <> ''").select("sheet", "row", F.col("c.col").alias("col"), F.col("c.text").alias("text"), text_to_number(F.col("c.text")).alias("num"))


def in_range(r1: int, c1: int, r2: int, c2: int) -> Column:
    r1, r2, c1, c2 = min(r1, r2), max(r1, r2), min(c1, c2), max(c1, c2)
    return F.col("row").between(r1, r2) & F.col("col").between(c1, c2)


def select_ranges(cells: DataFrame, ranges: list[tuple[int, int, int, int]]) -> DataFrame:
    """The union of rectangles; a cell in several counts once."""
    return cells.where(reduce(lambda a, b: a | b, (in_range(*r) for r in ranges)))


def extent(cells: DataFrame) -> DataFrame:
    """max_row and max_col, 1 for an empty sheet."""
    return cells.agg(F.coalesce(F.max("row"), F.lit(1)).alias("max_row"), F.coalesce(F.max("col"), F.lit(1)).alias("max_col"))


def insert_rows(cells: DataFrame, at: int, count: int = 1) -> DataFrame:
    return cells.withColumn("row", F.when(F.col("row") >= at, F.col("row") + count).otherwise(F.col("row")))


def insert_cols(cells: DataFrame, at: int, count: int = 1) -> DataFrame:
    return cells.withColumn("col", F.when(F.col("col") >= at, F.col("col") + count).otherwise(F.col("col")))


def delete_rows(cells: DataFrame, at: int, count: int = 1) -> DataFrame:
    kept = cells.where(~F.col("row").between(at, at + count - 1))
    return kept.withColumn("row", F.when(F.col("row") >= at + count, F.col("row") - count).otherwise(F.col("row")))


def delete_cols(cells: DataFrame, at: int, count: int = 1) -> DataFrame:
    kept = cells.where(~F.col("col").between(at, at + count - 1))
    return kept.withColumn("col", F.when(F.col("col") >= at + count, F.col("col") - count).otherwise(F.col("col")))


def clear(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    return cells.where(~in_range(r1, c1, r2, c2))


def set_values(cells: DataFrame, values: DataFrame, order: str | None = None) -> DataFrame:
    """values (sheet, row, col, text) replace the cells at their places; an empty text removes the cell.

    Of several values for a cell the last by order counts, or the greatest text.
    """
    one = values.groupBy("sheet", "row", "col").agg((F.max_by("text", F.col(order)) if order else F.max("text")).alias("text"))
    new = one.where("text <> ''").withColumn("num", text_to_number(F.col("text"))).select(*CELLS)
    return cells.join(values.select("sheet", "row", "col"), ["sheet", "row", "col"], "left_anti").select(*CELLS).unionByName(new)


def trim_spaces(cells: DataFrame) -> DataFrame:
    """Texts trimmed and their white space collapsed; `changed` tells which cells that altered."""
    trimmed = F.trim(F.regexp_replace("text", r"\s+", " "))
    return cells.withColumn("changed", trimmed != F.col("text")).withColumn("text", trimmed)


def find(cells: DataFrame, term: str) -> DataFrame:
    """Cells that contain term in any case; order by row and col to step through them."""
    return cells.where(F.contains(F.upper("text"), F.lit(term.upper())))


def row_keys(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """sheet, row, key: the row's display strings within the range, upper case, in column order."""
    pairs = F.sort_array(F.collect_list(F.struct("col", F.upper("text").alias("t"))))
    key = F.array_join(F.transform(pairs, lambda p: F.concat(p["col"].cast("string"), F.lit("\u0001"), p["t"])), "\u0001")
    return cells.where(in_range(r1, c1, r2, c2)).groupBy("sheet", "row").agg(key.alias("key"))


def dedup_rows(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """Of rows equal within the range the first stays; the later ones' cells there are cleared, not shifted."""
    keys = row_keys(cells, r1, c1, r2, c2)
    firsts = keys.groupBy("sheet", "key").agg(F.min("row").alias("first"))
    later = keys.join(firsts, ["sheet", "key"]).where("row > first").select("sheet", "row")
    inside, outside = cells.where(in_range(r1, c1, r2, c2)), cells.where(~in_range(r1, c1, r2, c2))
    return inside.join(later, ["sheet", "row"], "left_anti").select(*CELLS).unionByName(outside.select(*CELLS))


def distinct_rows(table: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Rows of a table, the first by order of those equal in columns (any case)."""
    keys = [F.upper(format_value(F.col(c), table.schema[c].dataType)).alias(f"key{k}_") for k, c in enumerate(columns)]
    names = table.columns
    kept = table.groupBy(*keys).agg(F.min_by(F.struct(*names), F.col(order)).alias("row_"))
    return kept.select(*(F.col(f"row_.{c}").alias(c) for c in names))


def sort_column(cells: DataFrame, col: int, descending: bool = False) -> DataFrame:
    """One column's texts, sorted as text and written from row 1; other columns stay."""
    order = F.col("text").desc() if descending else F.col("text")
    placed = numbered(cells.where(F.col("col") == col).withColumnRenamed("row", "row_"), ["sheet"], [order, "row_"], "row")
    return placed.select(*CELLS).unionByName(cells.where(F.col("col") != col).select(*CELLS))


def sort_rows(table: DataFrame, by: list[str], descending: list[bool] | None = None) -> DataFrame:
    """Whole rows, by several columns."""
    return table.orderBy(*(F.col(c).desc() if d else F.col(c) for c, d in zip(by, descending or [False] * len(by), strict=True)))


def to_table(cells: DataFrame, columns: int) -> DataFrame:
    """Display strings as a dense matrix (c1, c2, ...), blank rows left out."""
    values = [F.coalesce(F.max(F.when(F.col("col") == k, F.col("text"))), F.lit("")).alias(f"c{k}") for k in range(1, columns + 1)]
    return cells.where(F.col("col") <= columns).groupBy("sheet", "row").agg(*values)


def copy_tsv(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """A line of tab-separated display strings per row with a cell in the range."""
    width = max(c1, c2) - min(c1, c2) + 1
    matrix = to_table(cells.where(in_range(r1, c1, r2, c2)).withColumn("col", F.col("col") - (min(c1, c2) - 1)), width)
    return matrix.select("sheet", "row", F.concat_ws("\t", *(f"c{k}" for k in range(1, width + 1))).alias("line"))


def paste_tsv(blocks: DataFrame, row: int, col: int) -> DataFrame:
    """blocks (sheet, text): tab-separated lines as cells from an anchor on."""
    lines = blocks.select("sheet", F.posexplode(F.split("text", "\r?\n")).alias("r", "line"))
    parts = lines.select("sheet", "r", F.posexplode(F.split("line", "\t")).alias("c", "text")).where("text <> ''")
    return parts.select("sheet", (F.col("r") + row).cast("bigint").alias("row"), (F.col("c") + col).alias("col"), "text", text_to_number(F.col("text")).alias("num"))


def overlaps(a: str, b: str) -> Column:
    """Do the rectangles with columns r1, c1, r2, c2 of two aliases meet?"""
    return (F.col(f"{a}.r1") <= F.col(f"{b}.r2")) & (F.col(f"{a}.r2") >= F.col(f"{b}.r1")) & (F.col(f"{a}.c1") <= F.col(f"{b}.c2")) & (F.col(f"{a}.c2") >= F.col(f"{b}.c1"))


RECT = ["sheet", "r1", "c1", "r2", "c2"]
#: Rows of a sheet that rectangles meet in; those that share no band are never compared.
BAND = 256


def _banded(rectangles: DataFrame) -> DataFrame:
    return rectangles.withColumn("band", F.explode(F.sequence(F.floor(F.col("r1") / BAND), F.floor(F.col("r2") / BAND))))


def _overlapped(rectangles: DataFrame, others: DataFrame, more: Column | None = None) -> DataFrame:
    """Those of the rectangles that meet another (and for which `more`, of the aliases m and n, holds), some more than once."""
    on = (F.col("m.sheet") == F.col("n.sheet")) & (F.col("m.band") == F.col("n.band")) & overlaps("m", "n")
    met = _banded(rectangles).alias("m").join(_banded(others).alias("n"), on if more is None else on & more)
    return met.select(*(F.col(f"m.{c}") for c in RECT))


def merge_cells(merges: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """merges with those of new added and those that overlap them gone; a single cell doesn't merge. Columns sheet, r1, c1, r2, c2.

    Of new ranges that overlap each other the last by order stays, or by its corners.
    """
    place = [order] if order else RECT
    new = new.where((F.col("r1") < F.col("r2")) | (F.col("c1") < F.col("c2"))).select(*dict.fromkeys([*RECT, *place])).distinct()
    later = F.struct(*(F.col(f"n.{c}") for c in place)) > F.struct(*(F.col(f"m.{c}") for c in place))
    kept = new.join(_overlapped(new, new, later), RECT, "left_anti").select(*RECT)
    return merges.select(*RECT).join(_overlapped(merges.select(*RECT), new), RECT, "left_anti").unionByName(kept)


def unmerge(merges: DataFrame, selection: DataFrame) -> DataFrame:
    return merges.join(_overlapped(merges, selection), RECT, "left_anti")


def merge_at(places: DataFrame, merges: DataFrame) -> DataFrame:
    """places (sheet, row, col) with the first merged range, by its corners, that contains them: merge (r1, c1, r2, c2) or null."""
    band = F.floor(F.col("p.row") / BAND) == F.col("m.band")
    inside = F.col("p.row").between(F.col("m.r1"), F.col("m.r2")) & F.col("p.col").between(F.col("m.c1"), F.col("m.c2"))
    met = places.alias("p").join(_banded(merges).alias("m"), (F.col("p.sheet") == F.col("m.sheet")) & band & inside)
    corners = F.min(F.struct("m.r1", "m.c1", "m.r2", "m.c2")).alias("merge")
    found = met.groupBy("p.sheet", "p.row", "p.col").agg(corners)
    return places.join(found, ["sheet", "row", "col"], "left")


def cut(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> tuple[DataFrame, DataFrame]:
    """(the range as tab-separated lines, the cells without it)."""
    return copy_tsv(cells, r1, c1, r2, c2), clear(cells, r1, c1, r2, c2)


def range_rows(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """A range row by row: sheet, row, texts (an array of display strings, blank ones too), for every sheet with a cell in it. A task makes and fills some of the rows."""
    r1, r2, c1, c2 = min(r1, r2), max(r1, r2), min(c1, c2), max(c1, c2)
    inside = cells.where(in_range(r1, c1, r2, c2))
    width = c2 - c1 + 1
    filled = inside.groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), "text"))).alias("texts"))
    blank = F.transform(F.sequence(F.lit(c1), F.lit(c2)), lambda c: F.coalesce(F.try_element_at("texts", c), F.lit("")))
    starts = F.sequence(F.lit(r1).cast("bigint"), F.lit(r2).cast("bigint"), F.lit(1 << 16).cast("bigint"))
    every = inside.select("sheet").distinct().withColumn("from_", F.explode(starts)).repartition("sheet", "from_")
    every = every.select("sheet", F.explode(F.sequence("from_", F.least(F.lit(r2), F.col("from_") + (1 << 16) - 1))).alias("row"))
    empty = F.array_repeat(F.lit(""), width)
    return every.join(filled, ["sheet", "row"], "left").select("sheet", "row", F.when(F.col("texts").isNull(), empty).otherwise(blank).alias("texts"))


def range_table(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """A range as a document's table block: sheet, rows (an array per row of display strings, blank cells too). A block is one value; `range_rows` has a row for each of its rows."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "texts"))), lambda x: x["texts"])
    return range_rows(cells, r1, c1, r2, c2).groupBy("sheet").agg(ordered.alias("rows"))


# Sheets of a workbook: a list of names, in order; the cells carry the name.


def add_sheet(sheets: list[str], name: str | None = None) -> list[str]:
    """A further sheet; without a name it is SheetN, the first N from their number on that none has."""
    if not (name or "").strip():
        n, taken = len(sheets) + 1, {s.upper() for s in sheets}
        while f"SHEET{n}" in taken:
            n += 1
        name = f"Sheet{n}"
    return [*sheets, name]


def remove_sheet(sheets: list[str], cells: DataFrame, place: int) -> tuple[list[str], DataFrame]:
    """The sheet at a place (from 0) and its cells go; the last one stays."""
    if len(sheets) <= 1 or not 0 <= place < len(sheets):
        return sheets, cells
    return [*sheets[:place], *sheets[place + 1 :]], cells.where(F.col("sheet") != sheets[place])


def rename_sheet(sheets: list[str], cells: DataFrame, place: int, name: str) -> tuple[list[str], DataFrame]:
    """A new name, trimmed, for the sheet at a place; blank names and those that another sheet has, in any case, are refused."""
    name = name.strip()
    others = {s.upper() for k, s in enumerate(sheets) if k != place}
    if not (0 <= place < len(sheets) and name) or name.upper() in others:
        return sheets, cells
    renamed = cells.withColumn("sheet", F.when(F.col("sheet") == sheets[place], F.lit(name)).otherwise(F.col("sheet")))
    return [*sheets[:place], name, *sheets[place + 1 :]], renamed


def max_width(cells: DataFrame, least: int = 4, most: int = 60) -> DataFrame:
    """Display width per column."""
    return cells.groupBy("sheet", "col").agg(F.greatest(F.lit(least), F.least(F.lit(most), F.max(F.length("text")))).alias("width"))


def row_totals(table: DataFrame, columns: list[str]) -> DataFrame:
    """A total per column, for the row below the table."""
    return table.agg(*(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns))
