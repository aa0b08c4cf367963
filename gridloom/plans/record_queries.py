"""Keyed records, the upload queue and small catalogues, over the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import records as R
from gridloom.plans.log_queries import table


def _state(k):
    return F.element_at(F.array(*(F.lit(s) for s in R.STATES)), (k % 7 + 1).cast("int"))


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit(".png")).alias("display_name"), _state(F.col("o_orderkey")).alias("upload_state"), F.col("o_orderdate").alias("created_at"))


def record_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    store, changes = events.where("event_id % 3 = 0"), events.where("event_id % 3 <> 0")
    return R.upsert(R.latest(store, "id", "event_id"), changes, "id", "event_id")


def record_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.remove(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


def record_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.history(_captures(spark, sf_dir), "urgent", "Failed")


def record_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captures(spark, sf_dir).withColumn("retry", R.can_retry(F.col("upload_state"))).groupBy("upload_state", "retry").agg(F.count(F.lit(1)).alias("n"))


def record_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recover(_captures(spark, sf_dir)).groupBy("upload_state").agg(F.count(F.lit(1)).alias("n"))


def record_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event that moves a key decides; the SQL names the same states by hand."""
    moves = F.create_map(*(F.lit(x) for pair in (("signup", "enqueue"), ("view", "start"), ("error", "fail"), ("purchase", "shared"), ("click", "retry")) for x in pair))
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), moves[F.col("event_type")].alias("action"))
    return R.queue_states(events, "user_id", "at", "action")


def record_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("name", F.when(F.col("c_custkey") % 5 == 0, F.lit("  ")).otherwise(F.col("c_name")))
    return R.valid(rows, "c_custkey", "name", ["c_acctbal"]).select("c_custkey", "valid")


def record_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = table(spark, sf_dir, "events").select(F.concat(F.lit("/f/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("opened"))
    return R.recent_files(opened, "path", "opened")


def record_autosaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    saves = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("saved_at"))
    now = saves.agg(F.max("saved_at")).scalar()
    return R.autosaves(saves, now, 2).select("event_id", "saved_at")


def record_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.by_category(nations, "r_name", "n_name")


def record_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(R.age_label(F.col("ts"), F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00"))).alias("age")).groupBy("age").agg(F.count(F.lit(1)).alias("n"))


def record_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("shot"), (F.col("s_suppkey") % 4).cast("string"), F.lit(".png")).alias("name"))
    return R.unique_names(files, "name", "s_suppkey").select("s_suppkey", "unique_name")


def record_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", R.safe_name(F.concat("p_brand", F.lit('/a:b?'), "p_type")).alias("name"))


def record_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))).alias("points"))
    return points.select("l_orderkey", R.bounds(R.translate(F.col("points"), 10, 1)).alias("b")).select("l_orderkey", "b.left", F.round("b.top", 4).alias("top"), "b.right", F.round("b.bottom", 4).alias("bottom"))


def record_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    edges = part.select("src", (F.col("src") * 2).alias("dst")).unionByName(part.select("src", (F.col("src") + 7).alias("dst")).where("src % 10 = 0"))
    return R.reachable(edges, spark.range(1, 4).select(F.col("id").alias("node")))


QUERIES = {f.__name__: f for f in (
    record_upsert, record_remove, record_history, record_retry, record_recover, record_queue, record_valid, record_recent, record_autosaves, record_categories, record_ages, record_unique_names,
    record_safe_names, record_bounds, record_reachable,
)}

_CAPTURES = """
        WITH c AS (SELECT o_orderkey AS id, o_orderpriority || '.png' AS display_name, o_orderdate AS created_at,
                          ['LocalOnly', 'Pending', 'Uploading', 'UploadedPrivate', 'UploadedShared', 'Failed', 'AuthenticationRequired'][o_orderkey % 7 + 1] AS upload_state FROM orders) """
SQL = {
    "record_upsert": """
        WITH e AS (SELECT user_id AS id, event_id, event_type, event_id % 3 <> 0 AS change FROM events)
        SELECT id, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY change DESC, event_id DESC) = 1""",
    "record_remove": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "record_history": _CAPTURES + "SELECT * FROM c WHERE contains(upper(display_name), 'URGENT') AND upload_state IN ('Failed', 'AuthenticationRequired')",
    "record_retry": _CAPTURES + "SELECT upload_state, upload_state IN ('Failed', 'Pending', 'AuthenticationRequired') AS retry, count(*) AS n FROM c GROUP BY 1, 2",
    "record_recover": _CAPTURES + "SELECT CASE upload_state WHEN 'Uploading' THEN 'Pending' ELSE upload_state END AS upload_state, count(*) AS n FROM c GROUP BY 1",
    "record_queue": """
        WITH RECURSIVE e AS (SELECT user_id, event_type AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events),
             s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS no, 'LocalOnly' AS state, 0 AS retries FROM events
                   UNION ALL
                   SELECT s.user_id, e.no, CASE WHEN a IN ('signup', 'click') THEN 'Pending' WHEN a = 'view' AND state = 'Pending' THEN 'Uploading'
                                                WHEN a = 'purchase' AND state = 'Uploading' THEN 'UploadedShared' WHEN a = 'error' AND state = 'Uploading' THEN 'Failed' ELSE state END,
                          CAST(retries + (a = 'click')::INTEGER AS INTEGER)
                   FROM s JOIN e ON e.user_id = s.user_id AND e.no = s.no + 1)
        SELECT user_id, state, retries FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY no DESC) = 1""",
    "record_valid": "SELECT c_custkey, c_custkey % 5 <> 0 AND c_acctbal >= 0 AS valid FROM customer",
    "record_recent": "SELECT '/f/' || user_id AS path, max(event_id) AS opened FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "record_autosaves": "SELECT event_id, ts AS saved_at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAYS",
    "record_categories": "SELECT r_name, count(*) AS n, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "record_ages": """
        WITH m AS (SELECT ts, floor((epoch_us(TIMESTAMP '2024-01-05') - epoch_us(ts)) / 60e6) AS m FROM events)
        SELECT CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(m AS BIGINT) || ' min' WHEN m < 1440 THEN CAST(m AS BIGINT) // 60 || ' h'
                    WHEN m < 10080 THEN CAST(m AS BIGINT) // 1440 || ' d' ELSE strftime(ts, '%d/%m/%Y') END AS age, count(*) AS n FROM m GROUP BY 1""",
    "record_unique_names": """
        WITH n AS (SELECT s_suppkey, s_suppkey % 4 AS k, row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_suppkey) AS no FROM supplier)
        SELECT s_suppkey, 'shot' || k || CASE WHEN no > 1 THEN '-' || no ELSE '' END || '.png' AS unique_name FROM n""",
    "record_safe_names": r"""SELECT p_partkey, translate(p_brand || '/a:b?' || p_type, '\/:*?"<>|', '_________') AS name FROM part""",
    "record_bounds": """
        SELECT l_orderkey, min(l_quantity) + 10 AS "left", round(min(l_discount) + 1, 4) AS top, max(l_quantity) + 10 AS "right", round(max(l_discount) + 1, 4) AS bottom
        FROM lineitem GROUP BY l_orderkey""",
    "record_reachable": """
        WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey * 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey + 7 FROM part WHERE p_partkey % 10 = 0),
             r AS (SELECT unnest([1, 2, 3])::BIGINT AS node UNION SELECT dst FROM r JOIN e ON e.src = r.node)
        SELECT node FROM r""",
}
