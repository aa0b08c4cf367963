"""Activity-log operators: error rates, slow operations, sessions, retention, redaction."""

from __future__ import annotations

import os
import time
import traceback
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOW_MS, SLOW_LIMIT = 5000, 50
MESSAGE_CHARS = 4000

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
#: A row of the activity log.
LOG_SCHEMA = T.StructType(
    [T.StructField("id", _S), T.StructField("occurred_at", T.TimestampType()), T.StructField("received_at", T.TimestampType())]
    + [T.StructField(n, _S) for n in ("session_id", "app_version", "environment", "device", "os", "level", "category", "action", "tool_id", "file_name", "file_ext")]
    + [T.StructField("file_size_bytes", _L), T.StructField("result_size_bytes", _L), T.StructField("page_count", _I), T.StructField("item_count", _I)]
    + [T.StructField("duration_ms", _L), T.StructField("success", T.BooleanType())]
    + [T.StructField(n, _S) for n in ("message", "error_type", "error_detail")]
)
#: A row of the capture event log.
EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("correlationId", _S), T.StructField("eventName", _S), T.StructField("level", _S),
    T.StructField("durationMs", _L), T.StructField("succeeded", T.BooleanType()), T.StructField("errorCode", _S), T.StructField("message", _S),
    T.StructField("width", _I), T.StructField("height", _I), T.StructField("byteSize", _L),
])

# fixed values: what a log message must not hold, and what replaces it, in this order
_REDACTIONS = (
    (r"""(?i)(\\?"?Authorization\\?"?\s*:\s*\\?"?)(?:Bearer\s+)?[^"\s,;}]+""", "$1[REDACTED]"),
    (r"(?i)(\bBearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]"),
    (r"\bprivate_[A-Za-z0-9_\-]{8,}\b", "[REDACTED]"),
    (r"""(?i)(access_token|refresh_token|code)("?\s*[:=]\s*"?)([^"&\s}]+)""", "$1$2[REDACTED]"),
)


def recent_errors(log: DataFrame, now: Column, level: str = "level", at: str = "occurred_at", hours: int = 24) -> DataFrame:
    return log.where((F.col(level) == "error") & (F.col(at) > now - F.expr(f"INTERVAL {hours} HOURS"))).orderBy(F.col(at).desc())


def error_rate(log: DataFrame, by: str, failed: Column) -> DataFrame:
    """Per value of `by`: failures, total and the failure percentage to one decimal."""
    return log.groupBy(by).agg(
        F.count_if(failed).alias("failures"),
        F.count(F.lit(1)).alias("total"),
        F.round(100.0 * F.count_if(failed) / F.count(F.lit(1)), 1).alias("failure_pct"),
    )


def slow_operations(log: DataFrame, duration: str, threshold: float = SLOW_MS, limit: int = SLOW_LIMIT, tie: str = "id") -> DataFrame:
    """The slowest operations beyond a threshold: a top-k report."""
    return log.where(F.col(duration) > threshold).orderBy(F.col(duration).desc(), tie).limit(limit)


def session(log: DataFrame, key: str, value: object, at: str = "occurred_at") -> DataFrame:
    """One session's rows in time order, with the seconds since the row before."""
    rows = log.where(F.col(key) == F.lit(value))
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(Window.partitionBy(key).orderBy(at)).cast("timestamp"))
    return rows.withColumn("gap_s", gap / 1e6).orderBy(at)


def sessionize(log: DataFrame, user: str, at: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions of each user, broken where nothing happens for gap_minutes: user, first, last, events."""
    window = F.session_window(F.col(at).cast("timestamp"), f"{gap_minutes} minutes")
    return log.groupBy(user, window).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("events")).drop("session_window")


def retain(log: DataFrame, now: Column, days: int = 90, at: str = "occurred_at") -> DataFrame:
    return log.where(F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS"))


def retained_files(files: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """files (name like activity-20260906.ndjson): those dated within the last days."""
    day = F.try_to_timestamp(F.regexp_extract("name", r"-(\d{8})\.ndjson$", 1), F.lit("yyyyMMdd")).cast("date")
    return files.where(day >= F.date_sub(today, days))


def redact(message: Column) -> Column:
    for pattern, to in _REDACTIONS:
        message = F.regexp_replace(message, pattern, to)
    return message


def event_name(name: Column) -> Column:
    """Trimmed, lower case, everything but letters and digits an underscore."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{Nd}]", "_")


def truncate(text: Column, limit: int = MESSAGE_CHARS) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def capture_rows(events: DataFrame) -> DataFrame:
    """Capture events (EVENT_SCHEMA) as they are written: names normalised, error codes and messages redacted."""
    return events.withColumns({"eventName": event_name(F.col("eventName")), "errorCode": redact(F.col("errorCode")), "message": redact(F.col("message"))})


def recent_captures(log: DataFrame, limit: int = 200) -> DataFrame:
    """The newest rows of a capture log, newest first; messages are redacted on reading too, for rows that others wrote."""
    return log.withColumn("message", redact(F.col("message"))).orderBy(F.col("timestamp").desc(), "correlationId").limit(limit)


def search(log: DataFrame, term: str, columns: list[str], at: str) -> DataFrame:
    """Rows with term, in any case, in one of the columns; newest first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.upper(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term.upper()))
    return log.where(hit).orderBy(F.col(at).desc())


def newest(log: DataFrame, at: str, tie: str, limit: int = 200) -> DataFrame:
    return log.orderBy(F.col(at).desc(), tie).limit(limit)


def file_columns(path: Column) -> tuple[Column, Column]:
    """(file name, extension in lower case with its point; empty if it has none) of a path."""
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    return name, F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))


def tool_runs(runs: DataFrame, expected: list[str]) -> DataFrame:
    """Log rows of tool runs: tool_id, path, file_size, item_count, duration_ms, label, error, error_type, error_detail (null if all went well).

    An error of an expected type (a mistake in what the user gave) is a warning without detail, any other an error.
    """
    name, ext = file_columns(F.col("path"))
    failed, known = F.col("error").isNotNull(), F.coalesce(F.col("error_type").isin(expected), F.lit(False))
    return runs.select(
        F.when(~failed, "info").when(known, "warning").otherwise("error").alias("level"), F.lit("pdf-tool").alias("category"), F.lit("run").alias("action"), "tool_id",
        name.alias("file_name"), ext.alias("file_ext"), F.col("file_size").cast("bigint").alias("file_size_bytes"), F.col("item_count").cast("int").alias("item_count"),
        F.col("duration_ms").cast("bigint").alias("duration_ms"), (~failed).alias("success"), F.coalesce("error", "label").alias("message"),
        F.when(failed, F.col("error_type")).alias("error_type"), F.when(failed & ~known, truncate(F.col("error_detail"))).alias("error_detail"),
    )


def measured(work: Callable[[], object], write: Callable[[dict], None], category: str, action: str, tool_id: str | None = None, file_name: str | None = None, file_size: int | None = None) -> object:
    """Do a piece of work and write a log row (fields of LOG_SCHEMA) of how long it took; an error is written, then raised again."""
    ext = os.path.splitext(file_name)[1].lower() if file_name else None
    row = {"level": "info", "category": category, "action": action, "tool_id": tool_id, "file_name": file_name, "file_ext": ext, "file_size_bytes": file_size, "success": True}
    began = time.monotonic()
    try:
        result = work()
    except Exception as error:
        detail = "".join(traceback.format_exception(error))
        detail = detail if len(detail) <= MESSAGE_CHARS else detail[:MESSAGE_CHARS] + "…"  # as `truncate`
        took = int(1000 * (time.monotonic() - began))
        write(row | {"level": "error", "success": False, "duration_ms": took, "message": str(error), "error_type": type(error).__name__, "error_detail": detail})
        raise
    size = len(result) if isinstance(result, bytes | bytearray) else None
    write(row | {"duration_ms": int(1000 * (time.monotonic() - began)), "result_size_bytes": size})
    return result


def log_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of `measured` as a log."""
    return spark.createDataFrame([[row.get(f.name) for f in LOG_SCHEMA] for row in rows], LOG_SCHEMA)
