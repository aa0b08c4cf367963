"""Ranges and selections as rectangles, aggregates placed in a sheet, its versions, and names, criteria, queue and log windows of this kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import aggregates as A
from gridloom.operators import activity, records, styles
from gridloom.operators import pages as P
from gridloom.operators import rectangles as X
from gridloom.operators.rounds import new_path
from gridloom.operators.versions import CellHistory
from gridloom.plans.formula_queries import _pick
from gridloom.plans.grid_queries import _cells
from gridloom.plans.log_queries import table
from gridloom.sources import delimited, logs
from gridloom.streaming.log_stream import error_rates

SHEET_ROWS = 1_048_576


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' cells, some of them gone."""
    return _cells(spark, sf_dir).where("(row * 7 + col * 3) % 5 <> 0")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping ranges, a few for each formula; every fifth formula has a whole column too. Corners in any order."""
    k = F.col("s_suppkey")
    some = table(spark, sf_dir, "supplier").select((k % 20).alias("formula"), F.lit("Sheet1").alias("sheet"), (k * 13 % 900 + 1).alias("r1"), (k % 3 + 2).alias("c1"), (k * 13 % 900 + 1 + k % 7 * 30).alias("r2"), (k % 2 + 1).alias("c2"))
    whole = some.select("formula").distinct().where("formula % 5 = 0").select("formula", F.lit("Sheet1").alias("sheet"), F.lit(1).alias("r1"), F.lit(2).alias("c1"), F.lit(SHEET_ROWS).alias("r2"), F.lit(2).alias("c2"))
    return some.unionByName(whole)


def fn_countblank_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.countblank(_sparse(spark, sf_dir), _ranges(spark, sf_dir), ["formula"])


def grid_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.selection(_sparse(spark, sf_dir), _ranges(spark, sf_dir).where(f"r2 < {SHEET_ROWS}"), ["formula"]).select("formula", "places", "filled", "blanks", "count", "sum", F.round("average", 6).alias("average"))


def grid_style_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style over many overlapping ranges at once; counted by property, for the places are many."""
    k = F.col("c_custkey")
    styles = table(spark, sf_dir, "customer").select(F.lit("Sheet1").alias("sheet"), k.alias("row"), (k % 4).cast("int").alias("col"), (k % 2 == 0).alias("bold"), F.lit("general").alias("format"))
    changed = X.apply_style(styles, _ranges(spark, sf_dir).where("formula % 2 = 1").drop("formula"), bold=True)
    return changed.groupBy("col", "bold", "format").agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows"))


def grid_aggregate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = _ranges(spark, sf_dir).where(f"r2 < {SHEET_ROWS}").groupBy("formula", "sheet").agg(F.min("r1").alias("r1"), F.min("c2").alias("c1"), F.max("r1").alias("r2"), F.max("c1").alias("c2"))
    return X.aggregate_ranges(_sparse(spark, sf_dir), ranges, ["formula"], A.MAX).select("formula", "row", "col", "value")


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of numbers with gaps, and texts between."""
    key = F.col("o_orderkey")
    number = F.when(key % 17 == 3, F.lit("text")).otherwise((key % 101).cast("string"))
    cells = table(spark, sf_dir, "orders").select(F.lit("Sheet1").alias("sheet"), F.floor(key / 3).alias("row"), (key % 3 + 1).cast("int").alias("col"), number.alias("text"), F.when(key % 17 != 3, (key % 101).cast("double")).alias("num"))
    return cells.where("row % 13 <> 0 and row > 0")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.lit("Sheet1").alias("sheet"), (key * 5).alias("row"), (key % 4 + 1).cast("int").alias("col"))


def grid_aggregate_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.aggregate_block(_gapped(spark, sf_dir), _targets(spark, sf_dir), A.AVERAGE).select("row", "col", F.round("value", 6).alias("value"), "first_row")


def grid_aggregate_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.aggregate_above(_gapped(spark, sf_dir), _targets(spark, sf_dir).where("row % 200 = 0"), A.SUM).select("row", "col", "value")


def grid_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits, one of them undone and cut off by a third; three versions are read, and what differs between two."""
    cells, place = _cells(spark, sf_dir), ["sheet", "row", "col"]
    history = CellHistory(spark, new_path(spark, "history"))
    history.begin(cells)
    first = history.edit(cells.where("col = 2 and row % 3 = 0").select(*place, F.lit("12").alias("text")))
    history.edit(cells.where("col = 3 and row % 5 = 0").select(*place, F.lit("").alias("text")))
    history.undo()
    last = history.edit(cells.where("col <> 1 and row % 7 = 0").select(*place, F.when(F.col("col") == 2, F.lit("")).otherwise(F.lit("x")).alias("text")))
    read = lambda version: history.read(version).select(F.lit(f"v{version}").alias("version"), "row", "col", "text", "num")
    changed = history.difference(0, last).select(F.lit("changed").alias("version"), "row", "col", F.concat_ws(">", "before", "after").alias("text"), F.lit(None).cast("double").alias("num"))
    return read(0).unionByName(read(first)).unionByName(read(last)).unionByName(changed)


def record_unique_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in any case, names that look like numbered copies, and names that exist."""
    k = F.col("o_orderkey")
    name = _pick(F.floor(k / 7), "shot.png", "Shot.PNG", "shot-2.png", "shot-4.png", ".env", "b", "B-3", "shot-02.png")
    files = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(k.alias("id"), name.alias("name"))
    taken = table(spark, sf_dir, "nation").select(F.concat(F.lit("SHOT-"), (F.col("n_nationkey") * 3 + 1).cast("string"), F.lit(".png")).alias("name"))
    return records.unique_names(files, "name", "id", taken).select("id", "unique_name")


def fn_criteria_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that look like numbers to other readers are texts, in cells and in conditions."""
    text = _pick(F.col("p_partkey"), "nan", "inf", "1_0", "10", "NaN", "(5)", "1,000", "infinity", "1e3")
    rows = table(spark, sf_dir, "part").select("p_brand", text.alias("t"))
    count = lambda condition, name: A.COUNTIF(F.col("t"), condition, T.StringType()).alias(name)
    return rows.groupBy("p_brand").agg(
        count("nan", "nan"), count("=inf", "inf"), count("<>nan", "not_nan"), count("1_0", "under"), count("10", "ten"), count(">inf", "above_inf"), count("-5", "minus"), count("=(5)", "paren"), count(">=1,000", "thousand"))


def record_queue_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue with time: uploads under way too long are pending again, idle keys start anew."""
    moves = F.create_map(*(F.lit(x) for pair in (("signup", "enqueue"), ("view", "start"), ("error", "fail"), ("purchase", "shared"), ("click", "retry")) for x in pair))
    events = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), moves[F.col("event_type")].alias("action"))
    now = F.unix_millis(F.lit("2024-03-01 00:00:00").cast("timestamp"))
    return records.timed_states(events, "user_id", "at", "action", now, 60 * 60_000, 72 * 60 * 60_000)


def log_sliding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("tool_id"), F.col("ts").cast("timestamp").alias("occurred_at"), (F.col("event_type") != "error").alias("success"))
    rates = error_rates(events, window="6 hours", slide="2 hours")
    return rates.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "tool_id", "failures", "total")


def log_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by day, tool and session, then read for some days and tools."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("occurred_at"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("tool_id"))
    path = new_path(spark, "clustered-log")
    logs.write_clustered(events, path)
    days = logs.read_clustered(spark, path).where("log_date < date '2024-01-10' and tool_id in ('error', 'view')")
    return days.groupBy("log_date", "tool_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


def log_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts, which hold secrets, as messages of capture events."""
    docs = table(spark, sf_dir, "documents")
    names = _pick(F.col("doc_id"), " Capture.Started ", "upload failed!", "OCR-Done 2", "Zażółć")
    events = docs.select(
        F.timestamp_seconds(F.col("doc_id")).alias("timestamp"), F.col("doc_id").cast("string").alias("correlationId"), names.alias("eventName"), F.lit("Information").alias("level"),
        F.lit(None).cast("string").alias("errorCode"), F.concat(F.col("text"), F.lit(" access_token="), F.col("doc_id").cast("string"), F.lit("&Authorization: Bearer abc.d")).alias("message"))
    return activity.capture_rows(events).select("correlationId", "eventName", F.md5("message").alias("md5"))


def record_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("id"), F.col("p_type").alias("kind"))
    kind = records.of_kind(items, "kind", "ECONOMY").withColumn("found", F.lit("kind"))
    one = records.by_id(items, "id", "Brand#11", "p_partkey").withColumn("found", F.lit("id"))
    return kind.unionByName(one).unionByName(records.by_id(items, "id", "no such id", "p_partkey").withColumn("found", F.lit("none")))


def grid_csv_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank rows and cells are written too."""
    cells = _sparse(spark, sf_dir).where("row % 10 <> 4").withColumn("text", F.when(F.col("row") % 4 == 0, F.concat("text", F.lit(', "x"'))).otherwise(F.col("text")))
    return delimited.sheet_lines(cells)


def grid_format_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(_pick(F.col("p_partkey"), "Chung", "Tiền tệ (₫)", "Percent", "Hàng nghìn", "Ngày", "SCIENTIFIC", "Số nguyên", "Thập phân 2", "none"), F.lit(" "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", styles.code_of_label(label).alias("code"))


def page_inspect_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_linenumber")
    fonts = F.array(F.concat(F.lit("F"), (F.col("l_suppkey") % 3).cast("string")), F.concat(F.lit("F"), (key % 2).cast("string")))
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), key.alias("page_no"), F.when(key % 3 == 0, 842.0).otherwise(595.0).alias("width"), F.when(key % 3 == 0, 595.0).otherwise(842.0).alias("height"), fonts.alias("fonts"))
    return P.inspect_layout(pages)


QUERIES = {f.__name__: f for f in (
    fn_countblank_range, grid_selection, grid_style_ranges, grid_aggregate_range, grid_aggregate_block, grid_aggregate_above, grid_versions, record_unique_collisions, fn_criteria_words, record_queue_timed,
    log_sliding_rates, log_clustered, log_capture, record_templates, grid_csv_dense, grid_format_labels, page_inspect_layout,
)}

_CELLS = """
        WITH c AS (SELECT c_custkey AS row, 1 AS col, c_name AS text FROM customer UNION ALL SELECT c_custkey, 2, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 3, CAST(c_nationkey AS VARCHAR) FROM customer),
             s AS (SELECT * FROM c WHERE (row * 7 + col * 3) % 5 <> 0),
             g AS (SELECT s_suppkey % 20 AS formula, s_suppkey * 13 % 900 + 1 AS r1, s_suppkey % 2 + 1 AS c1, s_suppkey * 13 % 900 + 1 + s_suppkey % 7 * 30 AS r2, s_suppkey % 3 + 2 AS c2 FROM supplier),
             u AS (SELECT formula, least(r1, r2) AS r1, least(c1, c2) AS c1, greatest(r1, r2) AS r2, greatest(c1, c2) AS c2 FROM g),
             p AS (SELECT DISTINCT formula, row, CAST(unnest(range(c1, c2 + 1)) AS INTEGER) AS col FROM (SELECT formula, c1, c2, unnest(range(r1, r2 + 1)) AS row FROM u)) """
_GAPPED = """
        WITH n AS (SELECT o_orderkey // 3 AS row, o_orderkey % 3 + 1 AS col, o_orderkey % 101 AS num FROM orders WHERE o_orderkey % 17 <> 3 AND o_orderkey // 3 % 13 <> 0 AND o_orderkey // 3 > 0),
             t AS (SELECT c_custkey * 5 AS row, c_custkey % 4 + 1 AS col FROM customer WHERE c_custkey % 3 = 0) """
_TIMED = """
        WITH RECURSIVE e AS (SELECT user_id, CAST(epoch_ms(ts) AS BIGINT) AS ms, event_type AS a, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'start' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'shared' ELSE 'retry' END) AS no FROM events),
             s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS no, 'LocalOnly' AS state, 0 AS retries, 0 AS recovered, CAST(-1 AS BIGINT) AS since, CAST(-1 AS BIGINT) AS last FROM events
                   UNION ALL
                   SELECT user_id, no, CASE WHEN a IN ('signup', 'click') THEN 'Pending' WHEN a = 'view' AND was = 'Pending' THEN 'Uploading' WHEN a = 'purchase' AND was = 'Uploading' THEN 'UploadedShared'
                                            WHEN a = 'error' AND was = 'Uploading' THEN 'Failed' ELSE was END,
                          CAST(retries + (a = 'click')::INTEGER AS INTEGER), recovered, CASE WHEN a IN ('signup', 'click') OR (a = 'view' AND was = 'Pending') OR (a IN ('purchase', 'error') AND was = 'Uploading') THEN ms ELSE since END, ms
                   FROM (SELECT user_id, no, a, ms, retries, CASE WHEN due THEN 'Pending' ELSE state END AS was, CAST(recovered + due::INTEGER AS INTEGER) AS recovered, CASE WHEN due THEN since + 3600000 ELSE since END AS since
                         FROM (SELECT *, state = 'Uploading' AND since + 3600000 <= ms AS due
                               FROM (SELECT s.user_id, e.no, e.a, e.ms, CASE WHEN old THEN 'LocalOnly' ELSE s.state END AS state, CASE WHEN old THEN 0 ELSE s.retries END AS retries, CASE WHEN old THEN 0 ELSE s.recovered END AS recovered,
                                            CASE WHEN old THEN -1 ELSE s.since END AS since
                                     FROM (SELECT s.*, e.ms AS next_ms, s.last >= 0 AND s.last + 259200000 <= e.ms AS old FROM s JOIN e ON e.user_id = s.user_id AND e.no = s.no + 1) s JOIN e ON e.user_id = s.user_id AND e.no = s.no + 1)))),
             l AS (SELECT *, least(CAST(epoch_ms(TIMESTAMP '2024-03-01') AS BIGINT), last + 259200000) AS upto FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY no DESC) = 1)
        SELECT user_id, CASE WHEN state = 'Uploading' AND since + 3600000 <= upto THEN 'Pending' ELSE state END AS state, retries, CAST(recovered + (state = 'Uploading' AND since + 3600000 <= upto)::INTEGER AS INTEGER) AS recovered,
               last + 259200000 <= CAST(epoch_ms(TIMESTAMP '2024-03-01') AS BIGINT) AS expired FROM l"""
SQL = {
    "fn_countblank_range": _CELLS + f""", w AS (SELECT * FROM u UNION ALL SELECT DISTINCT formula, 1, 2, {SHEET_ROWS}, 2 FROM u WHERE formula % 5 = 0)
        SELECT formula, CAST(sum((r2 - r1 + 1) * (c2 - c1 + 1) - (SELECT count(*) FROM s WHERE row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2)) AS BIGINT) AS blanks FROM w GROUP BY formula""",
    "grid_selection": _CELLS + """
        SELECT formula, count(*) AS places, count(text) AS filled, count(*) - count(text) AS blanks, count(CASE WHEN p.col = 3 THEN text END) AS "count",
               coalesce(sum(CASE WHEN p.col = 3 THEN CAST(text AS DOUBLE) END), 0) AS "sum", round(coalesce(avg(CASE WHEN p.col = 3 THEN CAST(text AS DOUBLE) END), 0), 6) AS average
        FROM p LEFT JOIN s ON p.row = s.row AND p.col = s.col GROUP BY formula""",
    "grid_style_ranges": _CELLS + """, q AS (SELECT row, col FROM p WHERE formula % 2 = 1 UNION SELECT unnest(range(1, 1048577)), 2 WHERE EXISTS (SELECT 1 FROM u WHERE formula % 10 = 5)),
             y AS (SELECT c_custkey AS row, CAST(c_custkey % 4 AS INTEGER) AS col, c_custkey % 2 = 0 AS bold, 'general' AS format FROM customer),
             z AS (SELECT coalesce(y.row, q.row) AS row, coalesce(y.col, q.col) AS col, CASE WHEN q.row IS NULL THEN bold ELSE true END AS bold, format FROM y FULL JOIN q ON y.row = q.row AND y.col = q.col)
        SELECT col, bold, format, count(*) AS n, CAST(sum(row) AS BIGINT) AS rows FROM z GROUP BY ALL""",
    "grid_aggregate_range": _CELLS + """, b AS (SELECT formula, min(r1) AS r1, min(c1) AS c1, max(r1) AS r2, max(c2) AS c2 FROM g GROUP BY formula)
        SELECT formula, r2 + 1 AS row, CAST(c1 AS INTEGER) AS col, coalesce((SELECT max(CAST(text AS DOUBLE)) FROM s WHERE s.col = 3 AND s.row BETWEEN r1 AND r2 AND s.col BETWEEN c1 AND c2), 0) AS value FROM b""",
    "grid_aggregate_block": _GAPPED + """, m AS (SELECT n.* FROM n ANTI JOIN t USING (row, col)),
             i AS (SELECT *, row - row_number() OVER (PARTITION BY col ORDER BY row) AS island FROM m),
             b AS (SELECT col, avg(num) AS value, min(row) AS first_row, max(row) + 1 AS row FROM i GROUP BY col, island)
        SELECT t.row, CAST(t.col AS INTEGER) AS col, round(coalesce(value, 0), 6) AS value, first_row FROM t LEFT JOIN b USING (row, col)""",
    "grid_aggregate_above": _GAPPED + """
        SELECT t.row, CAST(t.col AS INTEGER) AS col, CAST(coalesce(sum(num), 0) AS DOUBLE) AS value FROM t LEFT JOIN n ON n.col = t.col AND n.row < t.row WHERE t.row % 200 = 0 AND t.row > 1 GROUP BY ALL""",
    "grid_versions": """
        WITH c AS (SELECT c_custkey AS row, 1 AS col, c_name AS text FROM customer UNION ALL SELECT c_custkey, 2, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 3, CAST(c_nationkey AS VARCHAR) FROM customer),
             a AS (SELECT row, col, text AS old, CASE WHEN col = 2 AND row % 3 = 0 THEN '12' ELSE text END AS text FROM c),
             b AS (SELECT row, col, old, CASE WHEN row % 7 = 0 AND col = 2 THEN '' WHEN row % 7 = 0 AND col = 3 THEN 'x' ELSE text END AS text FROM a)
        SELECT 'v0' AS version, row, col, text, TRY_CAST(text AS DOUBLE) AS num FROM c UNION ALL SELECT 'v1', row, col, text, TRY_CAST(text AS DOUBLE) FROM a
        UNION ALL SELECT 'v3', row, col, text, TRY_CAST(text AS DOUBLE) FROM b WHERE text <> '' UNION ALL SELECT 'changed', row, col, old || '>' || text, NULL FROM b WHERE old <> text""",
    "record_unique_collisions": r"""
        WITH f AS (SELECT o_orderkey AS id, ['shot.png', 'Shot.PNG', 'shot-2.png', 'shot-4.png', '.env', 'b', 'B-3', 'shot-02.png'][o_orderkey // 7 % 8 + 1] AS name FROM orders WHERE o_orderkey % 5 = 0),
             o AS (SELECT 'SHOT-' || (n_nationkey * 3 + 1) || '.PNG' AS k FROM nation),
             t AS (SELECT upper(name) AS k FROM f UNION SELECT k FROM o),
             r AS (SELECT id, name, upper(name) AS k, row_number() OVER (PARTITION BY upper(name) ORDER BY id) + (upper(name) IN (SELECT k FROM o))::INTEGER AS copy FROM f),
             n AS (SELECT DISTINCT k, regexp_extract(k, '^(.+?)(\.[^.]*)?$', 1) AS stem, regexp_extract(k, '^(.+?)(\.[^.]*)?$', 2) AS ext FROM r),
             x AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) + 1 AS copy FROM n, range(2, 4000) s(i) WHERE stem || '-' || i || ext NOT IN (SELECT k FROM t))
        SELECT id, CASE WHEN r.copy = 1 THEN name ELSE regexp_extract(name, '^(.+?)(\.[^.]*)?$', 1) || '-' || i || regexp_extract(name, '^(.+?)(\.[^.]*)?$', 2) END AS unique_name FROM r LEFT JOIN x ON x.k = r.k AND x.copy = r.copy""",
    "fn_criteria_words": """
        WITH t AS (SELECT p_brand, p_partkey % 9 AS k FROM part)
        SELECT p_brand, CAST(count(*) FILTER (WHERE k IN (0, 4)) AS DOUBLE) AS nan, CAST(count(*) FILTER (WHERE k = 1) AS DOUBLE) AS inf, CAST(count(*) FILTER (WHERE k NOT IN (0, 4)) AS DOUBLE) AS not_nan,
               CAST(count(*) FILTER (WHERE k = 2) AS DOUBLE) AS under, CAST(count(*) FILTER (WHERE k = 3) AS DOUBLE) AS ten, CAST(0 AS DOUBLE) AS above_inf, CAST(count(*) FILTER (WHERE k = 5) AS DOUBLE) AS minus,
               CAST(count(*) FILTER (WHERE k = 5) AS DOUBLE) AS paren, CAST(count(*) FILTER (WHERE k IN (6, 8)) AS DOUBLE) AS thousand
        FROM t GROUP BY p_brand""",
    "record_queue_timed": _TIMED,
    "log_sliding_rates": """
        WITH e AS (SELECT user_id % 5 AS tool_id, unnest([time_bucket(INTERVAL 2 HOURS, ts), time_bucket(INTERVAL 2 HOURS, ts) - INTERVAL 2 HOURS, time_bucket(INTERVAL 2 HOURS, ts) - INTERVAL 4 HOURS]) AS window_start, event_type FROM events)
        SELECT window_start, tool_id, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) AS total FROM e GROUP BY ALL""",
    "log_clustered": """
        SELECT CAST(ts AS DATE) AS log_date, event_type AS tool_id, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-10' AND event_type IN ('error', 'view') GROUP BY ALL""",
    "log_capture": r"""
        WITH m AS (SELECT doc_id, text || ' access_token=' || doc_id || '&Authorization: Bearer abc.d' AS m FROM documents),
             a AS (SELECT doc_id, regexp_replace(m, '(?i)(\\?"?Authorization\\?"?\s*:\s*\\?"?)(?:Bearer\s+)?[^"\s,;}]+', '\1[REDACTED]', 'g') AS m FROM m),
             b AS (SELECT doc_id, regexp_replace(m, '(?i)(\bBearer\s+)[A-Za-z0-9._~+/=-]+', '\1[REDACTED]', 'g') AS m FROM a),
             c AS (SELECT doc_id, regexp_replace(m, '\bprivate_[A-Za-z0-9_\-]{8,}\b', '[REDACTED]', 'g') AS m FROM b),
             d AS (SELECT doc_id, regexp_replace(m, '(?i)(access_token|refresh_token|code)("?\s*[:=]\s*"?)([^"&\s}]+)', '\1\2[REDACTED]', 'g') AS m FROM c)
        SELECT CAST(doc_id AS VARCHAR) AS "correlationId", ['capture_started', 'upload_failed_', 'ocr_done_2', 'zażółć'][doc_id % 4 + 1] AS "eventName", md5(m) AS md5 FROM d""",
    "record_templates": """
        SELECT p_partkey, p_brand AS id, p_type AS kind, 'kind' AS found FROM part WHERE p_type = 'ECONOMY'
        UNION ALL (SELECT p_partkey, p_brand, p_type, 'id' FROM part WHERE p_brand = 'Brand#11' ORDER BY p_partkey LIMIT 1)""",
    "grid_csv_dense": _CELLS + """, d AS (SELECT row, col, CASE WHEN row % 4 = 0 THEN chr(34) || text || ', ' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) ELSE text END AS text FROM s WHERE row % 10 <> 4 AND row > 0),
             r AS (SELECT unnest(range(1, (SELECT max(row) FROM d) + 1)) AS row)
        SELECT r.row, coalesce(max(CASE WHEN col = 1 THEN text END), '') || ',' || coalesce(max(CASE WHEN col = 2 THEN text END), '') || ',' || coalesce(max(CASE WHEN col = 3 THEN text END), '') AS line FROM r LEFT JOIN d USING (row) GROUP BY r.row""",
    "grid_format_labels": "SELECT p_partkey, [NULL, 'currency', 'percent', 'thousands', 'date', 'scientific', 'integer', 'decimal2', NULL][p_partkey % 9 + 1] AS code FROM part",
    "page_inspect_layout": """
        WITH p AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 3 = 0 THEN '842 x 595' ELSE '595 x 842' END AS size, unnest(['F' || l_suppkey % 3, 'F' || l_linenumber % 2]) AS font FROM lineitem),
             z AS (SELECT doc_id, size, count(*) // 2 AS n FROM p GROUP BY ALL),
             f AS (SELECT doc_id, string_agg(DISTINCT font, ', ' ORDER BY font) AS fonts FROM p GROUP BY doc_id)
        SELECT doc_id, string_agg(size || ': ' || n, ', ' ORDER BY n DESC, size) AS sizes, any_value(fonts) AS fonts FROM z JOIN f USING (doc_id) GROUP BY doc_id""",
}
