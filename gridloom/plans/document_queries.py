"""Ranges of pages, crop, differing lines, search from the caret, plain text, word wrap and dates of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import pages as P
from gridloom.plans.log_queries import table
from gridloom.plans.page_queries import _P, _pages


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_ranges(_pages(spark, sf_dir), "1-2; 4-; 2, 5").select("doc_id", "part", "label", "page_no", "source_page", F.md5("text").alias("md5"))


def page_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).cast("int").alias("page_no"), F.lit(10.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("p_size") * 10.0).alias("x2"), F.col("p_retailprice").alias("y2"))
    cropped = P.crop(boxes, 10, 20, 55, -5, [1, 2])
    return cropped.select("p_partkey", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


def page_compare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _pages(spark, sf_dir)
    right = left.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "^[^\n]*", "\tedited line\r")).otherwise(F.col("text")))
    return P.compare_lines(left, right).select("doc_id", "page_no", F.md5("line").alias("md5"), "side", "n")


def page_find_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    return P.find_next(blocks, "th", 1, 12)


def page_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "line"))
    blocks = lines.select("doc_id", "block_no", F.when(F.col("block_no") % 5 == 4, "PageBreak").otherwise("Paragraph").alias("kind"), F.split("line", " ").alias("runs"))
    return P.plain_text(blocks).select("doc_id", F.md5("text").alias("md5"))


def page_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", "p_brand", F.lit("  "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(P.wrap(text, 14), "/").alias("lines"))


def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    full = F.concat(F.lit(" D:"), F.date_format(day, "yyyyMMddHHmmss"), F.lit("+07'00'"))
    text = F.when(k == 0, full).when(k == 1, F.date_format(day, "yyyyMMdd")).when(k == 2, F.lit("D:2026")).otherwise("  ")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.readable_date(text).alias("shown"))


#: Narrow, wide and all other letters of a font, in thousandths of its size.
FONT = P.Font({c: 250 for c in "ilt .,"} | {c: 900 for c in "mwMW"}, 500)


def page_wrap_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabs, runs of blanks and words that are wider than a line."""
    text = F.concat(F.col("p_name"), F.lit("\t"), F.replace("p_type", F.lit(" "), F.lit("")), F.lit("  "), F.replace("p_type", F.lit(" "), F.lit("mm")), F.lit(" "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(P.wrap(text, 56.0, FONT, 10.0), "/").alias("lines"))


def page_compare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _pages(spark, sf_dir)
    right = left.withColumn("text", F.when(F.col("doc_id") % 3 > 0, F.regexp_replace("text", "^[^\n]*", "new\nline\nnew")).otherwise(F.col("text")))
    return P.compare_report(left, right, 2).select("doc_id", "page_no", "side", F.array_join("lines", "|").alias("shown"), "more")


def page_merge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose own numbers have gaps, some without an id."""
    pages = P.remove_pages(_pages(spark, sf_dir), [2, 3]).withColumn("doc_id", F.when(F.col("doc_id") % 100 != 7, F.col("doc_id")))
    return P.merge_documents(pages).select("doc_id", "page_no", F.md5("text").alias("md5"))


QUERIES = {f.__name__: f for f in (page_ranges, page_crop, page_compare_lines, page_find_next, page_plain_text, page_wrap, page_wrap_fonts, page_compare_report, page_merge_gaps, page_dates)}


def _wrap(source: str, key: str, text: str, width: str, limit: int) -> str:
    """Lines of a text by folds over words and characters; width: a character c's. A state is {lines, line, used}."""
    measure = f"coalesce(list_sum(list_transform(list_filter(string_split({{0}}, ''), lambda c: c <> ''), lambda c: {width})), 0)"
    cut = f"""list_reduce(list_transform(list_filter(string_split(w.line, ''), lambda c: c <> ''), lambda c: {{lines: '', line: c, used: {width}}}),
                  lambda a, c: CASE WHEN a.used + c.used > {limit} THEN {{lines: a.lines || a.line || '/', line: c.line, used: c.used}} ELSE {{lines: a.lines, line: a.line || c.line, used: a.used + c.used}} END)"""
    blank = measure.format("' '")
    return f"""
        WITH s AS (SELECT {key}, list_transform(string_split(replace({text}, chr(9), '    '), ' '), lambda w: {{lines: '', line: w, used: {measure.format("w")}}}) AS words FROM {source}),
             p AS (SELECT {key}, list_transform(words, lambda w: {{line: w.line, used: w.used, pieces: CASE WHEN w.used <= {limit} THEN {{lines: '', line: w.line, used: w.used}} ELSE {cut} END}}) AS words FROM s),
             f AS (SELECT {key}, list_reduce(list_transform(words, lambda w: {{line: w.line, used: w.used, pieces: w.pieces, lines: w.pieces.lines}}),
                   lambda a, w: CASE WHEN (CASE WHEN a.line = '' THEN 0 ELSE a.used + {blank} END) + w.used <= {limit}
                                     THEN {{line: CASE WHEN a.line = '' THEN w.line ELSE a.line || ' ' || w.line END, used: (CASE WHEN a.line = '' THEN 0 ELSE a.used + {blank} END) + w.used, pieces: a.pieces, lines: a.lines}}
                                     ELSE {{line: w.pieces.line, used: w.pieces.used, pieces: a.pieces, lines: a.lines || CASE WHEN a.line = '' THEN '' ELSE a.line || '/' END || w.pieces.lines}} END,
                   {{line: '', used: 0, pieces: {{lines: '', line: '', used: 0}}, lines: ''}}) AS t FROM p)
        SELECT {key}, t.lines || t.line AS lines FROM f"""


_WORDS = "p_name || chr(9) || replace(p_type, ' ', '') || '  ' || replace(p_type, ' ', 'mm') || ' ' || p_brand"
_WIDTH = "CASE WHEN contains('ilt .,', c) THEN 250 WHEN contains('mwMW', c) THEN 900 ELSE 500 END"

_B = "WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents)"
SQL = {
    "page_ranges": _P + """, t AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS t FROM p),
             r AS (SELECT *, 1 AS part FROM t WHERE page_no <= 2 UNION ALL SELECT *, 2 FROM t WHERE page_no BETWEEN least(4, t) AND greatest(4, t) UNION ALL SELECT *, 3 FROM t WHERE page_no IN (2, 5)),
             g AS (SELECT doc_id, part, min(page_no) AS a, max(page_no) AS b FROM r GROUP BY 1, 2)
        SELECT doc_id, part, 'pages_' || CASE WHEN a = b THEN CAST(a AS VARCHAR) WHEN part = 3 THEN a || '_' || b ELSE a || '-' || b END AS label,
               CAST(row_number() OVER (PARTITION BY doc_id, part ORDER BY page_no) AS INTEGER) AS page_no, page_no AS source_page, md5(text) AS md5
        FROM r JOIN g USING (doc_id, part)""",
    "page_crop": """
        WITH b AS (SELECT p_partkey, p_partkey % 4 IN (1, 2) AS cut, 10.0::DOUBLE AS x1, p_size * 10.0::DOUBLE AS x2, p_retailprice AS y2 FROM part)
        SELECT p_partkey, round(CASE WHEN cut THEN x1 + (x2 - x1) * 0.1::DOUBLE ELSE x1 END, 6) AS x1, round(CASE WHEN cut THEN y2 * 0.2::DOUBLE ELSE 0.0::DOUBLE END, 6) AS y1,
               round(CASE WHEN cut THEN x2 - (x2 - x1) * 0.4::DOUBLE ELSE x2 END, 6) AS x2, round(y2, 6) AS y2 FROM b""",
    "page_compare_lines": _P + r""", a AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS line FROM p),
             b AS (SELECT doc_id, page_no, unnest(string_split(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^[^\n]*', 'edited line') ELSE text END, chr(10))) AS line FROM p),
             u AS (SELECT doc_id, page_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line, 1 AS k FROM a UNION ALL SELECT doc_id, page_no, regexp_replace(line, '^\s+|\s+$', '', 'g'), -1 FROM b),
             d AS (SELECT doc_id, page_no, line, sum(k) AS k FROM u WHERE line <> '' GROUP BY ALL)
        SELECT doc_id, page_no, md5(line) AS md5, CASE WHEN k > 0 THEN 'removed' ELSE 'added' END AS side, CAST(abs(k) AS BIGINT) AS n FROM d WHERE k <> 0""",
    "page_find_next": _B + """, h AS (
             SELECT doc_id, no, CASE WHEN no < 1 THEN 1 ELSE 0 END AS turn, CASE WHEN no = 1 THEN CASE WHEN instr(substr(upper(line), least(12, length(line)) + 1), 'TH') > 0
                    THEN instr(substr(upper(line), least(12, length(line)) + 1), 'TH') + least(12, length(line)) ELSE 0 END ELSE instr(upper(line), 'TH') END AS pos FROM b
             UNION ALL SELECT doc_id, no, 2, instr(upper(line), 'TH') FROM b WHERE no = 1)
        SELECT doc_id, CAST(no AS INTEGER) AS block_no, CAST(pos - 1 AS INTEGER) AS "offset" FROM h WHERE pos > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY turn, no) = 1""",
    "page_plain_text": _B + """
        SELECT doc_id, md5(string_agg(CASE WHEN no % 5 = 4 THEN chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ELSE replace(line, ' ', '') || chr(10) END, '' ORDER BY no)) AS md5 FROM b GROUP BY doc_id""",
    "page_wrap": _wrap("part", "p_partkey", "concat_ws(' ', p_name, p_brand, '  ', p_type)", "1", 14),
    "page_wrap_fonts": _wrap("part", "p_partkey", _WORDS, _WIDTH, 5600),
    "page_compare_report": _P + r""", a AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM p),
             b AS (SELECT doc_id, page_no, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no
                   FROM (SELECT *, CASE WHEN doc_id % 3 > 0 THEN regexp_replace(text, '^[^\n]*', 'new' || chr(10) || 'line' || chr(10) || 'new') ELSE text END AS t FROM p)),
             u AS (SELECT 'removed' AS side, * FROM a UNION ALL SELECT 'added', * FROM b),
             t AS (SELECT side, doc_id, page_no, no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM u),
             k AS (SELECT *, row_number() OVER (PARTITION BY side, doc_id, page_no, line ORDER BY no) AS turn FROM t WHERE line <> ''),
             r AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.side <> k.side AND o.doc_id = k.doc_id AND o.page_no = k.page_no AND o.line = k.line AND o.turn = k.turn)),
             n AS (SELECT *, row_number() OVER (PARTITION BY side, doc_id, page_no ORDER BY no) AS rank FROM r)
        SELECT doc_id, page_no, side, string_agg(line, '|' ORDER BY rank) FILTER (WHERE rank <= 2) AS shown, count(*) FILTER (WHERE rank > 2) AS more FROM n GROUP BY ALL""",
    "page_merge_gaps": _P + """, g AS (SELECT CASE WHEN doc_id % 100 = 7 THEN NULL ELSE doc_id END AS id, page_no, text FROM p WHERE page_no NOT IN (2, 3))
        SELECT 'merged' AS doc_id, row_number() OVER (ORDER BY id NULLS FIRST, page_no, text) AS page_no, md5(text) AS md5 FROM g""",
    "page_dates": """
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN 'D:2026' END AS shown FROM orders""",
}
