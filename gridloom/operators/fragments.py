"""Text fragments with places (doc_id, page_no, text, x, y, width, size) to lines and tables.

A page's fragments are one row's array, so everything happens within a row, in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.pages import detect_columns

_FRAGMENT = "struct<y:double,x:double,text:string,width:double,size:double>"


def _page_arrays(fragments: DataFrame) -> DataFrame:
    """A row per page: its fragments from the top down, then from the left."""
    one = F.struct((-F.col("y").cast("double")).alias("y"), F.col("x").cast("double").alias("x"), "text", F.col("width").cast("double").alias("width"), F.col("size").cast("double").alias("size"))
    return fragments.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(one)).alias("fragments"))


def _lines(ordered: Column) -> Column:
    """Arrays of fragments: a new line begins where y leaves the line's first y by more than max(2, size / 2)."""

    def step(acc: Column, f: Column) -> Column:
        last = F.element_at(acc["lines"], -1)
        same = (F.size(acc["lines"]) > 0) & (F.abs(f["y"] - acc["y"]) <= F.greatest(F.lit(2.0), f["size"] * 0.5))
        longer = F.concat(F.slice(acc["lines"], 1, F.size(acc["lines"]) - 1), F.array(F.concat(last, F.array(f))))
        lines = F.when(same, longer).otherwise(F.concat(acc["lines"], F.array(F.array(f))))
        return F.struct(F.when(same, acc["y"]).otherwise(f["y"]).alias("y"), lines.alias("lines"))

    first = F.struct(F.lit(0.0).alias("y"), F.array().cast(f"array<array<{_FRAGMENT}>>").alias("lines"))
    by_x = lambda line: F.array_sort(line, lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))
    return F.aggregate(ordered, first, step, lambda acc: F.transform(acc["lines"], by_x))


def _line_text(line: Column) -> Column:
    """Fragments from the left; a gap of over a quarter of the size is a space, of over four times that a column gap."""

    def step(acc: Column, f: Column) -> Column:
        gap, space = f["x"] - acc["right"], F.greatest(F.lit(1.0), acc["size"] * 0.25)
        blank = F.when(acc["text"].isNull(), "").when(gap > space * 4, "    ").when(gap > space, " ").otherwise("")
        return F.struct(F.concat(F.coalesce(acc["text"], F.lit("")), blank, f["text"]).alias("text"), (f["x"] + f["width"]).alias("right"), f["size"].alias("size"))

    first = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("right"), F.lit(0.0).alias("size"))
    return F.aggregate(line, first, step, lambda acc: F.rtrim(acc["text"]))


def text_lines(fragments: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no (from 1, blank lines left out), text."""
    texts = F.filter(F.transform(_lines(F.col("fragments")), _line_text), lambda t: t != "")
    return _page_arrays(fragments).select("doc_id", "page_no", F.posexplode(texts).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def tables(fragments: DataFrame) -> DataFrame:
    """doc_id, page_no, row_no (from 1), cells: a line's fragments joined within the columns of its page."""
    pages = _page_arrays(fragments).withColumn("starts", detect_columns(F.transform("fragments", lambda f: f["x"])))

    def cells(line: Column) -> Column:
        column = lambda f: F.greatest(F.size(F.filter(F.col("starts"), lambda s: f["x"] >= s - 1)), F.lit(1))
        within = lambda k: F.filter(F.transform(F.filter(line, lambda f: column(f) == k), lambda f: F.trim(f["text"])), lambda t: t != "")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("starts"), F.lit(1))), lambda k: F.array_join(within(k), " "))

    rows = F.filter(F.transform(_lines(F.col("fragments")), cells), lambda r: F.exists(r, lambda c: c != ""))
    return pages.select("doc_id", "page_no", F.posexplode(rows).alias("row_no", "cells")).withColumn("row_no", F.col("row_no") + 1)


def merge_runs(runs: DataFrame, formats: list[str]) -> DataFrame:
    """runs (block_id, run_no, text and formats): neighbours of equal format become one; run_no is the first one's."""
    window = Window.partitionBy("block_id").orderBy("run_no")
    same = F.lit(True)
    for c in formats:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(window))
    starts = F.when(same & F.lag("run_no").over(window).isNotNull(), 0).otherwise(1)
    numbered = runs.withColumn("starts_", starts).withColumn("group_", F.sum("starts_").over(window))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("run_no", "text"))), lambda s: s["text"])
    return numbered.groupBy("block_id", "group_", *formats).agg(F.min("run_no").alias("run_no"), F.array_join(ordered, "").alias("text")).drop("group_")


def split_run(text: Column, start: int, end: int) -> Column:
    """A run's text before, within and after an interval of characters, as an array."""
    return F.array(F.substring(text, F.lit(1), F.lit(start)), F.substring(text, F.lit(start + 1), F.lit(end - start)), F.substring(text, F.lit(end + 1), F.length(text)))


def map_point(x: Column, y: Column, from_size: tuple[float, float], to_size: tuple[float, float]) -> tuple[Column, Column]:
    """Whole coordinates on a surface of another size; halves go away from zero."""
    return F.round(x * (to_size[0] / from_size[0])), F.round(y * (to_size[1] / from_size[1]))
