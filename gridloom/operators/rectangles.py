"""Rectangles of cells as rows of a table: selections and ranges of any size, never as lists of their places.

rectangles: sheet, r1, c1, r2, c2 (corners, both within; any two opposite ones), and columns that name what they belong to
(`by`). Areas come from a sweep: the rows at which rectangles begin or end cut a selection into strips, within which the columns covered
don't change, and intervals of columns merge in each. A rectangle is a row for each strip that it spans, so whole columns
cost as little as single cells. Cells meet rectangles in bands whose height follows the rectangle's, at most two for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import aggregates as A
from gridloom.functions.coerce import to_number
from gridloom.operators.rounds import before, running

CORNERS = ["r1", "c1", "r2", "c2"]
#: Bands are powers of this high.
BAND, LEVELS = 256, 4
#: Places that a task makes at once.
PLACES = 1 << 16


def rectangles(spark: SparkSession, sheet: str, ranges: list[tuple[int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(sheet, *map(int, r)) for r in ranges], "sheet string, r1 bigint, c1 bigint, r2 bigint, c2 bigint")


def _upright(rects: DataFrame) -> DataFrame:
    ends = {"r1": F.least("r1", "r2"), "c1": F.least("c1", "c2"), "r2": F.greatest("r1", "r2"), "c2": F.greatest("c1", "c2")}
    return rects.withColumns({c: v.cast("bigint") for c, v in ends.items()})


def area(rects: DataFrame, by: list[str]) -> DataFrame:
    """by, area: each rectangle on its own, so what lies in two counts twice."""
    size = (F.col("r2") - F.col("r1") + 1) * (F.col("c2") - F.col("c1") + 1)
    return _upright(rects).groupBy(*by).agg(F.sum(size).alias("area"))


def pieces(rects: DataFrame, by: list[str]) -> DataFrame:
    """by and disjoint rectangles that cover what the given ones do: one per strip and run of columns."""
    rects = _upright(rects).select(*by, *CORNERS).distinct()
    rows = rects.select(*by, F.explode(F.array(F.col("r1"), F.col("r2") + 1)).alias("row")).distinct()
    order = Window.partitionBy(*by).orderBy("row")  # the rows where rectangles begin or end
    strips = rows.select(*by, "row", F.row_number().over(order).alias("strip"), F.lead("row").over(order).alias("next"))
    ends = strips.select(*by, F.col("row").alias("end"), F.col("strip").alias("last"))
    spans = rects.join(strips.select(*by, F.col("row").alias("r1"), F.col("strip").alias("first")), [*by, "r1"]).withColumn("end", F.col("r2") + 1).join(ends, [*by, "end"])
    spans = spans.select(*by, "c1", "c2", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("strip")).distinct()
    across = Window.partitionBy(*by, "strip").orderBy("c1", "c2")
    reach = F.max("c2").over(across.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("opens", F.coalesce(F.col("c1") > reach + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(across))
    runs = runs.groupBy(*by, "strip", "run").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2"))
    return runs.join(strips, [*by, "strip"]).select(*by, F.col("row").alias("r1"), "c1", (F.col("next") - 1).alias("r2"), "c2")


def union_area(rects: DataFrame, by: list[str]) -> DataFrame:
    """by, area: what several rectangles cover counts once."""
    return area(pieces(rects, by), by)


def _leveled(rects: DataFrame) -> DataFrame:
    """rects with level (bands of BAND ** (level + 1) rows) and band, at most two of them."""
    height, level = F.col("r2") - F.col("r1") + 1, F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(height <= BAND ** (k + 1), F.lit(k)).otherwise(level)
    rows = F.pow(F.lit(float(BAND)), F.col("level") + 1)
    return rects.withColumn("level", level).withColumn("band", F.explode(F.array_distinct(F.array(F.floor(F.col("r1") / rows), F.floor(F.col("r2") / rows)))))


def within(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """cells (sheet, row, col and more) with the other columns of each rectangle that they lie in, a row for each."""
    extra = [c for c in rects.columns if c not in ("sheet", *CORNERS, *cells.columns)]
    rects = _leveled(_upright(rects))
    levels = [r[0] for r in rects.select("level").distinct().collect()]  # four at most
    bands = F.array(*(F.struct(F.lit(k).alias("level_"), F.floor(F.col("row") / float(BAND ** (k + 1))).alias("band_")) for k in levels or [0]))
    here = cells.select("*", F.inline(bands))
    there = rects.select(F.col("sheet").alias("sheet_"), F.col("level").alias("level_"), F.col("band").alias("band_"), *CORNERS, *extra)
    met = here.withColumn("sheet_", F.col("sheet")).join(there, ["sheet_", "level_", "band_"]).where("row between r1 and r2 and col between c1 and c2")
    return met.select(*cells.columns, *extra)


def countblank(cells: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """by, blanks: the places of ranges without a text, each range on its own, as COUNTBLANK takes its arguments. ranges: by, sheet and corners."""
    filled = within(cells.where("text <> ''").select("sheet", "row", "col"), ranges.select(*dict.fromkeys([*by, "sheet", *CORNERS]))).groupBy(*by).agg(F.count(F.lit(1)).alias("filled"))
    return area(ranges, by).join(filled, by, "left").select(*by, (F.col("area") - F.coalesce("filled", F.lit(0))).alias("blanks"))


def selection(cells: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """What a status bar tells of selections: by, places, filled, blanks, count, sum and average of numbers; a place in several ranges counts once."""
    parts = pieces(ranges, [*dict.fromkeys([*by, "sheet"])])
    met = within(cells.where("text <> ''").select("sheet", "row", "col", "num"), parts)
    values = met.groupBy(*by).agg(F.count(F.lit(1)).alias("filled"), F.count("num").alias("count"), F.sum("num").alias("sum"), F.avg("num").alias("average"))
    out = area(parts, by).join(values, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*by, F.col("area").alias("places"), zero("filled").alias("filled"), (F.col("area") - zero("filled")).alias("blanks"), zero("count").alias("count"), zero("sum").alias("sum"), zero("average").alias("average"))


def places(rects: DataFrame) -> DataFrame:
    """sheet, row, col of every place that rectangles cover, once: made in many tasks, PLACES at a time. Rows of the result are places, so a whole column is a sheet's height."""
    parts = pieces(rects, ["sheet"])
    rows = F.greatest(F.lit(1), F.floor(PLACES / (F.col("c2") - F.col("c1") + 1)))
    chunks = parts.withColumn("rows", rows).withColumn("first", F.explode(F.sequence(F.col("r1"), F.col("r2"), F.col("rows"))))
    chunks = chunks.repartition("sheet", "first", "c1").withColumn("row", F.explode(F.sequence("first", F.least(F.col("r2"), F.col("first") + F.col("rows") - 1))))
    return chunks.select("sheet", "row", F.explode(F.sequence(F.col("c1").cast("int"), F.col("c2").cast("int"))).alias("col"))


def apply_style(styles: DataFrame, rects: DataFrame, **changes: object) -> DataFrame:
    """styles (sheet, row, col and a column per property) with properties changed where rectangles lie. Only places without a style are made."""
    place, kind = ["sheet", "row", "col"], {f.name: f.dataType for f in styles.schema}
    value = lambda name: F.lit(changes[name]).cast(kind[name])
    keys = styles.select(*place).distinct()
    chosen = within(keys, pieces(rects, ["sheet"])).withColumn("chosen_", F.lit(True))  # pieces are disjoint, so a place is chosen once
    marked = styles.join(chosen, place, "left")
    changed = marked.select(*(F.when(F.col("chosen_"), value(c)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in styles.columns))
    missing = places(rects).join(keys, place, "left_anti")
    new = lambda c: F.col(c) if c in place else value(c) if c in changes else F.lit(None)
    return changed.unionByName(missing.select(*(new(c).cast(kind[c]).alias(c) for c in styles.columns)))


def aggregate_ranges(cells: DataFrame, ranges: DataFrame, by: list[str], function: Callable[[Column], Column]) -> DataFrame:
    """A result per range, for the place below its first column: by, sheet, row, col, value. function: an aggregate such as aggregates.AVERAGE."""
    ranges = _upright(ranges)
    met = within(cells.select("sheet", "row", "col", "num"), ranges.select(*dict.fromkeys([*by, "sheet", *CORNERS])))
    values = ranges.select(*by).join(met.select(*by, "num"), by, "left").groupBy(*by).agg(function(F.col("num")).alias("value"))
    below = ranges.groupBy(*by).agg(F.max("sheet").alias("sheet_"), (F.max("r2") + 1).alias("row"), F.min("c1").cast("int").alias("col"))
    return below.join(values, by).select(*by, *(() if "sheet" in by else (F.col("sheet_").alias("sheet"),)), "row", "col", "value")


def _by_parts(function: Callable[[Column], Column]) -> tuple[dict[str, tuple[str, Column]], Column] | None:
    """What is summed up of each part of some numbers, and the result of it; None for an aggregate that those of its parts don't tell."""
    number, zero = F.col("num"), F.lit(0.0)
    total, count = ("sum", number), ("sum", F.when(number.isNotNull(), F.lit(1.0)))
    return {
        A.SUM: ({"sum_": total}, F.coalesce("sum_", zero)),
        A.AVERAGE: ({"sum_": total, "count_": count}, F.coalesce(F.col("sum_") / F.col("count_"), zero)),
        A.COUNT: ({"count_": count}, F.coalesce("count_", zero)),
        A.MIN: ({"least_": ("min", number)}, F.coalesce("least_", zero)),
        A.MAX: ({"most_": ("max", number)}, F.coalesce("most_", zero)),
    }.get(function)


def aggregate_above(cells: DataFrame, targets: DataFrame, function: Callable[[Column], Column]) -> DataFrame:
    """targets (sheet, row, col) with value: an aggregate of all numbers above them in their column; targets in row 1 have none above and go.

    SUM, AVERAGE, COUNT, MIN and MAX run down a column in ranges of rows, each number read once however many targets are below it. Any other
    function, such as MEDIAN, isn't told by its parts: there each number is read for every target below it.
    """
    mine = targets.where("row > 1").select("sheet", "row", "col").distinct()
    numbers = cells.where("num is not null").select("sheet", "row", "col", "num")
    parts = _by_parts(function)
    if parts is None:
        met = mine.withColumnRenamed("row", "target").join(numbers, ["sheet", "col"], "left").withColumn("num", F.when(F.col("row") < F.col("target"), F.col("num")))
        return met.groupBy("sheet", F.col("target").alias("row"), "col").agg(function(F.col("num")).alias("value"))
    sums, value = parts
    below = numbers.join(mine.select("sheet", "col").distinct(), ["sheet", "col"], "left_semi")  # columns with a target
    rows = mine.select("sheet", "col", "row", F.lit(None).cast("double").alias("num"), F.lit(0).alias("turn_")).unionByName(
        below.select("sheet", "col", "row", to_number(F.col("num")).alias("num"), F.lit(1).alias("turn_")))  # a number beside the target comes after it
    told = before(rows, ["sheet", "col"], ["row", "turn_"], sums).where("turn_ = 0")
    kind = {f.name: f.dataType for f in targets.schema}
    return told.select("sheet", F.col("row").cast(kind["row"]).alias("row"), F.col("col").cast(kind["col"]).alias("col"), value.alias("value"))


def aggregate_block(cells: DataFrame, targets: DataFrame, function: Callable[[Column], Column]) -> DataFrame:
    """targets (sheet, row, col) with value and first_row: an aggregate of the block of numbers that ends right above them (first_row null, and nothing to aggregate, if there is none).

    Blocks are islands of rows: a number with none above it begins one, and a running count of beginnings, in ranges of rows, names it, so that
    a column of any length is many tasks. What stands at a target is no number any more, so blocks end there.
    """
    at = ["sheet", "col", "row"]
    mine = targets.select("sheet", "col", F.col("row").cast("bigint").alias("row")).distinct()
    numbers = cells.where("num is not null").select("sheet", "col", F.col("row").cast("bigint").alias("row"), "num").join(mine, at, "left_anti")
    above = numbers.select("sheet", "col", (F.col("row") + 1).alias("row"), F.lit(0).alias("begins"))
    marked = numbers.join(above, at, "left").withColumn("begins", F.coalesce("begins", F.lit(1)).cast("bigint"))
    named = running(marked, at, "before", F.col("begins")).withColumn("block", F.col("before") + F.col("begins"))
    ends = mine.join(named.select("sheet", "col", (F.col("row") + 1).alias("row"), "block"), at, "left")
    # a block ends right above one target at most, so each number is read once
    met = ends.join(named.select("block", "num", F.col("row").alias("of")), "block", "left")
    return met.groupBy("sheet", "row", "col").agg(function(F.col("num")).alias("value"), F.min("of").alias("first_row"))
