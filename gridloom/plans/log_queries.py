"""Activity-log queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import activity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def log_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("tool", F.col("user_id") % 25)
    return activity.error_rate(events, "tool", F.col("event_type") == "error")


def log_recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    now = events.agg(F.max("ts")).scalar()
    return activity.recent_errors(events, now, "event_type", "ts").select("event_id", "user_id", "ts", "value")


def log_slow_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.slow_operations(_events(spark, sf_dir), "value", 50.0, tie="event_id").select("event_id", "user_id", "value")


def log_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.session(_events(spark, sf_dir), "user_id", 7, "ts").select("event_id", "ts", "event_type", F.round("gap_s", 3).alias("gap_s"))


def log_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.sessionize(_events(spark, sf_dir), "user_id", "ts", 30)


def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    now = events.agg(F.max("ts")).scalar()
    return activity.retain(events, now, 3, "ts").select("event_id", "ts")


def log_event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _events(spark, sf_dir).withColumn("name", activity.event_name(F.concat(F.lit("  "), F.upper("event_type"), F.lit(".Done "))))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def log_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("retry access_token=abc"), F.col("event_id").cast("string"), F.lit("&x=1 Authorization: Bearer k."), F.col("user_id").cast("string"))
    return _events(spark, sf_dir).where("event_type = 'error'").select("event_id", activity.redact(raw).alias("message"))


def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.search(_events(spark, sf_dir), "SIGN", ["event_type", "props"], "ts").select("event_id", "event_type", "ts")


def log_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.min(k).alias("k_min"), F.max(k).alias("k_max"), F.count(k).alias("k_count"))


def log_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (log_error_rate, log_recent_errors, log_slow_operations, log_session, log_sessionize, log_retention, log_event_names, log_redacted, log_search, log_props, log_hourly)}

SQL = {
    "log_error_rate": """
        SELECT user_id % 25 AS tool, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) AS total,
               round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 1) AS failure_pct
        FROM events GROUP BY user_id % 25""",
    "log_recent_errors": """
        SELECT event_id, user_id, ts, value FROM events
        WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS""",
    "log_slow_operations": "SELECT event_id, user_id, value FROM events WHERE value > 50 ORDER BY value DESC, event_id LIMIT 50",
    "log_session": """
        SELECT event_id, ts, event_type, round((epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 1e6, 3) AS gap_s
        FROM events WHERE user_id = 7""",
    "log_sessionize": """
        WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES
                                              OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS opens FROM events),
             s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
        SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM s GROUP BY user_id, no""",
    "log_retention": "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAYS",
    "log_event_names": """
        SELECT regexp_replace(lower(trim('  ' || upper(event_type) || '.Done ')), '[^a-z0-9]', '_', 'g') AS name, count(*) AS n, round(sum(value), 2) AS total
        FROM events GROUP BY 1""",
    "log_redacted": """
        SELECT event_id, 'retry access_token=[REDACTED]&x=1 Authorization: [REDACTED]' AS message FROM events WHERE event_type = 'error'""",
    "log_search": "SELECT event_id, event_type, ts FROM events WHERE contains(upper(event_type), 'SIGN') OR contains(upper(coalesce(props, '')), 'SIGN')",
    "log_props": """
        SELECT event_type, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_min, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max,
               count(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_count FROM events GROUP BY event_type""",
    "log_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
