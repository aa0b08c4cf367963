"""Document operators: pages(doc_id, page_no, text), lines and fragments."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.rounds import running

PAGE_BREAK = "\f"
#: What is trimmed off lines: all Unicode white space.
BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Lines of a page's report that are shown a side.
REPORT_LINES = 15


def to_pages(docs: DataFrame, lines_per_page: int | None = None) -> DataFrame:
    """docs (doc_id, text): a row per page, at form feeds or every so many lines."""
    if lines_per_page is None:
        return docs.select("doc_id", F.posexplode(F.split("text", PAGE_BREAK)).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(lines_per_page))
    return docs.select("doc_id", F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice(lines, s + 1, lines_per_page), "\n"))).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


# fixed values: words of page expressions
_ALL, _EVEN, _ODD, _LAST = ("all", "tất cả", "tat ca", "*"), ("even", "chẵn", "chan"), ("odd", "lẻ", "le"), ("n", "cuối", "cuoi", "last")


def parse_pages(expression: str, total: int) -> list[int]:
    """Page numbers of an expression: all, even, odd, lists, ranges a-b, open ranges a-; last for the final page."""
    text = expression.strip().lower()
    for words, pages in ((_ALL, range(1, total + 1)), (_EVEN, range(2, total + 1, 2)), (_ODD, range(1, total + 1, 2))):
        if text in words:
            return list(pages)

    def number(word: str, default: int) -> int:
        return total if word in _LAST else int(word) if re.fullmatch(r"[+-]?\d+", word) else default

    chosen: set[int] = set()
    for part in filter(None, (x.strip() for x in re.split("[,;]", text))):
        if ranged := re.fullmatch(r"([^-]+)-(.*)", part):
            ends = number(ranged[1].strip(), 1), number(ranged[2].strip(), total)
        else:
            ends = (number(part, 0),) * 2
        chosen.update(range(max(1, min(ends)), min(total, max(ends)) + 1))
    return sorted(chosen)


def select_pages(pages: DataFrame, wanted: list[int]) -> DataFrame:
    return pages.where(F.col("page_no").isin(wanted))


def remove_pages(pages: DataFrame, unwanted: list[int]) -> DataFrame:
    return pages.where(~F.col("page_no").isin(unwanted))


def matching(pages: DataFrame, kind: str) -> DataFrame:
    """even or odd pages of documents of any length."""
    return pages.where(F.col("page_no") % 2 == (0 if kind == "even" else 1))


def renumber(pages: DataFrame, *order: Column) -> DataFrame:
    return pages.withColumn("page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(*(order or (F.col("page_no"),)))))


def reverse(pages: DataFrame) -> DataFrame:
    return renumber(pages, F.col("page_no").desc())


def reorder(pages: DataFrame, order: list[int]) -> DataFrame:
    """The listed pages first, in that order, then the rest."""
    place = F.array_position(F.array(*(F.lit(p) for p in order)), F.col("page_no").cast("int"))
    return renumber(pages, F.when(place > 0, place).otherwise(F.lit(len(order) + 1)), F.col("page_no"))


def split_every(pages: DataFrame, size: int) -> DataFrame:
    """pages with part (from 1) of `size` pages each."""
    return pages.withColumn("part", (F.floor((F.col("page_no") - 1) / size) + 1).cast("int"))


def _in_pages(expression: str, page: Column, total: Column) -> Column:
    """Does the expression name this page of a document of so many?"""
    text = expression.strip().lower()
    for words, chosen in ((_ALL, F.lit(True)), (_EVEN, page % 2 == 0), (_ODD, page % 2 == 1)):
        if text in words:
            return chosen

    def number(word: str, default: Column) -> Column:
        return total if word in _LAST else F.lit(int(word)) if re.fullmatch(r"[+-]?\d+", word) else default

    hit = F.lit(False)
    for part in filter(None, (x.strip() for x in re.split("[,;]", text))):
        if ranged := re.fullmatch(r"([^-]+)-(.*)", part):
            a, b = number(ranged[1].strip(), F.lit(1)), number(ranged[2].strip(), total)
        else:
            a = b = number(part, F.lit(0))
        hit = hit | page.between(F.least(a, b), F.greatest(a, b))
    return hit


def split_ranges(pages: DataFrame, ranges: str, label: str = "pages_") -> DataFrame:
    """Parts of a document by ranges such as "1-3; 4-; 2, 5": a page may be in several. Columns doc_id, part (from 1), label, page_no (in the part), source_page, text.

    Ranges that name no page of a document make no part of it.
    """
    chunks = [c for c in ranges.split(";") if c]
    if not chunks:
        raise ValueError("no ranges, such as 1-3; 4-6; 7")
    totals = pages.groupBy("doc_id").agg(F.max("page_no").alias("total_"))
    page, total = F.col("page_no"), F.col("total_")
    parts = F.filter(F.array(*(F.when(_in_pages(c, page, total), F.lit(k)) for k, c in enumerate(chunks, 1))), lambda k: k.isNotNull())
    rows = pages.join(totals, "doc_id").select("doc_id", F.explode(parts).alias("part"), F.col("page_no").alias("source_page"), "text")
    named = describe_pages(rows.select(F.struct("doc_id", "part").alias("doc_id"), F.col("source_page").alias("page_no")))
    named = named.select("doc_id.doc_id", "doc_id.part", F.concat(F.lit(label), F.replace("pages", F.lit(", "), F.lit("_"))).alias("label"))
    place = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("source_page")).alias("page_no")
    return rows.join(named, ["doc_id", "part"]).select("doc_id", "part", "label", place, "source_page", "text")


def merge_documents(pages: DataFrame, order: str = "doc_id", into: str = "merged") -> DataFrame:
    """All pages as one document, numbered from 1 without gaps: a page's place in its document (whose own numbers may have gaps), after the running sum of the documents' page counts.

    Documents stand in the order of `order`, one without it first; of pages with one number the smaller text comes first.
    """
    counts = pages.groupBy(order).agg(F.count(F.lit(1)).alias("n_"))
    offsets = running(counts, [order], "before_pages_", F.col("n_")).select(F.col(order).alias("order_"), "before_pages_")
    place = F.row_number().over(Window.partitionBy(order).orderBy("page_no", "text"))
    placed = pages.withColumn("place_", place).join(offsets, F.col(order).eqNullSafe(F.col("order_")))
    return placed.select(F.lit(into).alias("doc_id"), (F.col("before_pages_") + F.col("place_")).alias("page_no"), "text")


def rotate(pages: DataFrame, degrees: int, wanted: list[int]) -> DataFrame:
    return pages.withColumn("rotation", F.when(F.col("page_no").isin(wanted), F.pmod(F.col("rotation") + degrees, F.lit(360))).otherwise(F.col("rotation")))


def crop(pages: DataFrame, left: float, bottom: float, right: float, top: float, wanted: list[int] | None = None) -> DataFrame:
    """pages (x1, y1, x2, y2) with so many per cent of their width or height cut off each side, 0 to 40 of each."""
    left, bottom, right, top = (min(max(x, 0.0), 40.0) / 100 for x in (left, bottom, right, top))
    if left + right >= 0.9 or bottom + top >= 0.9:
        raise ValueError("nothing would remain of a page")
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    new = {"x1": F.col("x1") + width * left, "y1": F.col("y1") + height * bottom, "x2": F.col("x2") - width * right, "y2": F.col("y2") - height * top}
    chosen = F.lit(True) if wanted is None else F.col("page_no").isin(wanted)
    return pages.withColumns({c: F.when(chosen, v).otherwise(F.col(c)) for c, v in new.items()})


def n_up(pages: DataFrame, per_sheet: int, columns: int) -> DataFrame:
    """sheet, slot, grid row and column of each page."""
    slot = (F.col("page_no") - 1) % per_sheet
    return pages.withColumns({
        "sheet_no": (F.floor((F.col("page_no") - 1) / per_sheet) + 1).cast("int"), "slot": slot.cast("int"),
        "grid_row": F.floor(slot / columns).cast("int"), "grid_col": (slot % columns).cast("int"),
    })


def fit(width: Column, height: Column, to_width: float, to_height: float) -> tuple[Column, Column, Column]:
    """(scale, left, top) that fits and centres a page on another size."""
    scale = F.least(to_width / width, to_height / height)
    return scale, (to_width - width * scale) / 2, (to_height - height * scale) / 2


def describe_pages(numbers: DataFrame) -> DataFrame:
    """numbers (doc_id, page_no): runs as text, such as 1-3, 7, 10-12."""
    distinct = numbers.select("doc_id", F.col("page_no").cast("bigint").alias("page_no")).distinct()
    island = F.col("page_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    runs = distinct.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))), lambda s: s["t"])
    return runs.groupBy("doc_id").agg(F.array_join(ordered, ", ").alias("pages"))


def extract_text(pages: DataFrame) -> DataFrame:
    """A document's pages joined with form feeds."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda s: s["text"])
    return pages.groupBy("doc_id").agg(F.array_join(ordered, "\n\f\n").alias("text"))


def find_text(pages: DataFrame, term: str, match_case: bool = False) -> DataFrame:
    """pages that contain term, with its number of occurrences. An empty term is found nowhere; letters match in any case one by one, so "ss" doesn't find "ß"."""
    if not term:
        return pages.withColumn("hits", F.lit(0).cast("bigint")).where("false")
    pattern = ("" if match_case else "(?iu)") + re.escape(term)
    return pages.withColumn("hits", F.regexp_count("text", F.lit(pattern)).cast("bigint")).where("hits > 0")


def replace_text(pages: DataFrame, old: str, new: str, match_case: bool = True) -> DataFrame:
    pattern = ("" if match_case else "(?i)") + re.escape(old)
    return pages.withColumn("replaced", F.regexp_count("text", F.lit(pattern))).withColumn("text", F.regexp_replace("text", pattern, new.replace("\\", r"\\").replace("$", r"\$")))


def redact(pages: DataFrame, term: str, mark: str = "█") -> DataFrame:
    return replace_text(pages, term, mark * len(term), match_case=False)


def placeholders(template: Column, page: Column, pages: Column, file: Column, date: Column) -> Column:
    for name, value in (("{page}", page), ("{pages}", pages), ("{file}", file), ("{date}", date)):
        template = F.replace(template, F.lit(name), value.cast("string"))
    return template


def compare_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines that differ, per page (doc_id, page_no): line, side (removed or added) and how often; multisets of trimmed non-blank lines."""

    def lines(pages: DataFrame, count: str) -> DataFrame:
        exploded = pages.select("doc_id", "page_no", F.explode(F.split("text", "\n")).alias("line"))
        trimmed = exploded.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")
        return trimmed.groupBy("doc_id", "page_no", "line").agg(F.count(F.lit(1)).alias(count))

    both = lines(left, "n_left").join(lines(right, "n_right"), ["doc_id", "page_no", "line"], "full_outer")
    more = F.coalesce("n_left", F.lit(0)) - F.coalesce("n_right", F.lit(0))
    side = F.when(more > 0, F.lit("removed")).otherwise(F.lit("added"))
    return both.withColumn("more", more).where("more <> 0").select("doc_id", "page_no", "line", side.alias("side"), F.abs("more").alias("n"))


def compare_documents(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per page (doc_id, page_no): numbers of lines removed and added; changed pages only."""
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).alias(side)
    return compare_lines(left, right).groupBy("doc_id", "page_no").agg(of("removed"), of("added"))


def compare_report(left: DataFrame, right: DataFrame, most: int = REPORT_LINES) -> DataFrame:
    """What a reader of the comparison sees: doc_id, page_no, side (removed or added), lines (the first `most`, in the page's order, an array), more (how many others).

    Equal lines are used up from the top: the n-th of a text on one side meets the n-th on the other, and what is left over are the later ones.
    """

    def lines(pages: DataFrame) -> DataFrame:
        numbered = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")
        return numbered.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "page_no", "line").orderBy("place")))

    def left_over(mine: DataFrame, others: DataFrame, side: str) -> DataFrame:
        counts = others.groupBy("doc_id", "page_no", "line").agg(F.count(F.lit(1)).alias("n"))
        return mine.join(counts, ["doc_id", "page_no", "line"], "left").where(F.col("turn") > F.coalesce("n", F.lit(0))).select("doc_id", "page_no", F.lit(side).alias("side"), "place", "line")

    a, b = lines(left), lines(right)
    rest = left_over(a, b, "removed").unionByName(left_over(b, a, "added"))
    by = ["doc_id", "page_no", "side"]
    first = rest.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("place"))).where(F.col("rank") <= most)  # each task keeps so many before rows are shuffled
    shown = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    counts = rest.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return shown.join(counts, by).select(*by, "lines", (F.col("n") - F.size("lines")).alias("more"))


def find_next(blocks: DataFrame, term: str, caret_block: int, caret_offset: int, match_case: bool = False) -> DataFrame:
    """blocks (doc_id, block_no from 0, text): per document the next place of term from the caret on, round the end if needed: block_no, offset (from 0)."""
    pattern = ("" if match_case else "(?iu)") + re.escape(term)  # places are those of the text itself, whose length upper case may change
    place = lambda text: F.when(text.rlike(pattern), F.length(F.split(text, pattern, 2)[0]) + 1).otherwise(0)
    text, at_caret, block = F.col("text"), F.col("block_no") == caret_block, F.col("block_no")
    begin = F.least(F.lit(caret_offset), F.length("text"))
    rest = place(F.substring(text, begin + 1, F.length(text)))
    ahead = F.when(at_caret, F.when(rest > 0, rest + begin).otherwise(0)).otherwise(place(text))
    # blocks after the caret, blocks before it, and the caret's own block from its start, in this order
    turns = F.array(
        F.struct(F.when(block >= caret_block, 0).otherwise(1).alias("turn"), block.alias("block_no"), ahead.alias("at")),
        F.struct(F.when(at_caret, 2).alias("turn"), block.alias("block_no"), place(text).alias("at")),
    )
    found = blocks.select("doc_id", F.explode(turns).alias("f")).where("f.turn is not null and f.at > 0")
    return found.groupBy("doc_id").agg(F.min("f").alias("f")).select("doc_id", "f.block_no", (F.col("f.at") - 1).alias("offset"))


def gather_runs(runs: DataFrame) -> DataFrame:
    """runs (doc_id, block_no, run_no, kind, text) as blocks: doc_id, block_no, kind, runs (an array of texts, in order). Each run is shuffled."""
    ordered = F.array_sort(F.collect_list(F.struct("run_no", F.coalesce("text", F.lit("")).alias("text"))))
    return runs.groupBy("doc_id", "block_no").agg(F.max("kind").alias("kind"), F.transform(ordered, lambda r: r["text"]).alias("runs"))


def plain_text(blocks: DataFrame, page_break: str = "--- PAGE BREAK ---") -> DataFrame:
    """blocks (doc_id, block_no, kind, runs: an array of texts): a document's blocks as lines, each its runs' texts; kind PageBreak shows the mark.

    What is shuffled is a row per block, its line. A table with a row per run (run_no and text in place of runs) is gathered into blocks first.
    """
    if "run_no" in blocks.columns:
        blocks = gather_runs(blocks)
    line = F.when(F.col("kind") == "PageBreak", F.lit(f"\n{page_break}\n\n")).otherwise(F.concat(F.coalesce(F.array_join("runs", ""), F.lit("")), F.lit("\n")))
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "line")))
    return blocks.select("doc_id", "block_no", line.alias("line")).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda b: b["line"]), "").alias("text"))


class Font:
    """Widths of a font's characters in thousandths of its size: by character, and one for all others. Characters beyond U+03FF have that one."""

    def __init__(self, widths: dict[str, int], default: int):
        codes = {ord(c): w for c, w in widths.items() if ord(c) < 1024}
        self.table, self.default = [codes.get(k, default) for k in range(max(codes, default=-1) + 1)], default

    def width(self, char: Column) -> Column:
        if not self.table:
            return F.lit(self.default)
        return F.coalesce(F.get(F.array(*map(F.lit, self.table)), F.ascii(char)), F.lit(self.default))

    def measure(self, text: Column) -> Column:
        """The sum of the widths of a text's characters, in thousandths."""
        return F.aggregate(_chars(text), F.lit(0), lambda n, c: n + self.width(c))


#: Every character as wide as the size.
EVEN = Font({}, 1000)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def wrap(text: Column, width: float, font: Font = EVEN, size: float = 1.0) -> Column:
    """A text's lines, filled word by word up to a width, in a font of a size (by default: up to so many characters).

    Tabs are four blanks, and blanks within a line stay, but for those that it would begin with. A word wider than a line is cut
    where it is full, and the rest of it begins the next line.
    """
    limit, blank = math.floor(width * 1000 / size + 1e-9), font.width(F.lit(" "))
    none = F.array().cast("array<string>")

    def state(lines: Column, line: Column, used: Column) -> Column:
        return F.struct(lines.alias("lines"), line.alias("line"), used.cast("int").alias("used"))

    def cut(acc: Column, c: Column) -> Column:
        full = (acc["line"] != "") & (acc["used"] + font.width(c) > limit)
        return F.when(full, state(F.array_append(acc["lines"], acc["line"]), c, font.width(c))).otherwise(state(acc["lines"], F.concat(acc["line"], c), acc["used"] + font.width(c)))

    def step(acc: Column, word: Column) -> Column:
        empty, wide = acc["line"] == "", word["width"]
        longer = state(acc["lines"], F.when(empty, word["text"]).otherwise(F.concat(acc["line"], F.lit(" "), word["text"])), F.when(empty, wide).otherwise(acc["used"] + blank + wide))
        # the line so far is full, and the word begins the next one, in pieces if it has to
        before = F.when(empty, acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"]))
        whole = state(before, word["text"], wide)
        pieces = F.aggregate(_chars(word["text"]), state(before, F.lit(""), F.lit(0)), cut)
        return F.when(longer["used"] <= limit, longer).when(wide <= limit, whole).otherwise(pieces)

    def wrapped(paragraph: Column) -> Column:
        words = F.transform(F.split(F.replace(paragraph, F.lit("\t"), F.lit("    ")), " "), lambda w: F.struct(w.alias("text"), font.measure(w).alias("width")))
        return F.aggregate(words, state(none, F.lit(""), F.lit(0)), step, lambda acc: F.array_append(acc["lines"], acc["line"]))

    return F.flatten(F.transform(F.split(text, "\n"), wrapped))


def readable_date(text: Column) -> Column:
    """A date such as D:20260828142530+07'00' as dd/MM/yyyy HH:mm; a text that is none as it is, null for a blank one."""
    digits = F.regexp_replace(F.trim(text), "^D:", "")
    stamp = F.try_to_timestamp(F.when(F.length(digits) >= 14, F.left(digits, F.lit(14))), F.lit("yyyyMMddHHmmss"))
    day = F.try_to_timestamp(F.when(F.length(digits) >= 8, F.left(digits, F.lit(8))), F.lit("yyyyMMdd"))
    shown = F.coalesce(F.date_format(stamp, "dd/MM/yyyy HH:mm"), F.date_format(day, "dd/MM/yyyy"), text)
    return F.when(F.trim(text) != "", shown)


def inspect(pages: DataFrame) -> DataFrame:
    """Per document: pages, characters, words, blank pages."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).cast("bigint").alias("words"), F.count_if(F.trim("text") == "").alias("blank_pages"),
    )


def inspect_layout(pages: DataFrame) -> DataFrame:
    """Per document: sizes (each size of its pages, in points, with how many have it, the most frequent first) and fonts (in order). pages: doc_id, page_no, width, height, fonts (an array)."""
    shown = F.concat(F.format_string("%.0f x %.0f", F.col("width"), F.col("height")))
    counts = pages.groupBy("doc_id", shown.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "size")))
    sizes = counts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["size"], F.lit(": "), (-x["less"]).cast("string"))), ", ").alias("sizes"))
    fonts = pages.select("doc_id", F.explode("fonts").alias("font")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("font")), ", ").alias("fonts"))
    return sizes.join(fonts, "doc_id", "left")


def canonical_objects(objects: DataFrame, key: str, content: str) -> DataFrame:
    """Every object with the lowest key that has the same content (SHA-256)."""
    hashed = objects.withColumn("sha", F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256))
    canon = hashed.groupBy("sha").agg(F.min(key).alias("canonical"), F.count(F.lit(1)).alias("copies"))
    return hashed.select(key, "sha").join(canon, "sha").select(key, "canonical", "copies")


def detect_columns(xs: Column, gap: float = 12.0, most: int = 24) -> Column:
    """Column starts among sorted x places: a new one where x is more than gap beyond the last kept; one if there are too many."""
    places = F.array_sort(F.array_distinct(F.transform(xs, lambda x: F.round(x).cast("double"))))
    starts = F.aggregate(places, F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > gap), F.concat(acc, F.array(x))).otherwise(acc))
    return F.when(F.size(starts) > most, F.slice(starts, 1, 1)).otherwise(starts)


def column_of(starts: Column, x: Column) -> Column:
    """The number, from 1, of the last start at or before x (a point of slack)."""
    return F.greatest(F.size(F.filter(starts, lambda s: s <= x + 1)), F.lit(1))


def set_metadata(current: Column, value: str | None) -> Column:
    """None keeps, empty removes, anything else sets."""
    return current if value is None else F.lit(None).cast("string") if value == "" else F.lit(value)


def column_widths(table: DataFrame, columns: list[str], least: int = 3, most: int = 40) -> DataFrame:
    """Each column's share of the table's width, from its longest text."""
    widths = table.agg(*(F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)))).alias(c) for c in columns))
    total = sum((F.col(c) for c in columns), F.lit(0))
    return widths.select(*((F.col(c) / total).alias(c) for c in columns))
