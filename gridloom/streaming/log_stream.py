"""Structured Streaming over activity logs: de-duplicated rows, windowed error rates, an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators import records
from gridloom.operators.activity import LOG_SCHEMA
from gridloom.sources.keyed import KeyedTable

PERIOD = "20 seconds"
FILES_PER_BATCH = 200


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def once(log: DataFrame, key: str = "id", at: str = "occurred_at", delay: str = "1 hour") -> DataFrame:
    """Rows delivered more than once within the delay count once; state older than that is dropped."""
    return log.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def error_rates(log: DataFrame, by: str = "tool_id", at: str = "occurred_at", window: str = "10 minutes", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Failures and total per tool and window, which begins every `slide` (else windows don't overlap); late rows are taken up to the delay."""
    grouped = log.withWatermark(at, delay).groupBy(F.window(at, window, slide), by)
    counts = grouped.agg(F.count_if(~F.coalesce(F.col("success"), F.lit(True))).alias("failures"), F.count(F.lit(1)).alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), by, "failures", "total")


def queue_stream(events: DataFrame, key: str = "id", at: str = "occurred_at", event: str = "action") -> DataFrame:
    """The upload queue's state per key after each micro-batch: key, state, retries. Rows of a key are folded in time order."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, retries = state.get if state.exists else (records.STATES[0], 0)
        rows = pd.concat(list(frames)).sort_values(at)
        for name in rows[event]:
            now = "Pending" if name in records.RESTARTS else records.MOVES.get((now, name), now)
            retries += name == "retry"
        state.update((now, retries))
        yield pd.DataFrame({key: [group[0]], "state": [now], "retries": [retries]})

    out = f"{key} string, state string, retries int"
    return events.select(key, at, event).groupBy(key).applyInPandasWithState(step, out, "state string, retries int", "update", GroupStateTimeout.NoTimeout)


def write_once(log: DataFrame, table: str, checkpoint: str, key: str = "id", period: str = PERIOD) -> StreamingQuery:
    """Append each batch to a Parquet folder by day, leaving out ids that the batch repeats; a batch that runs again replaces its own folder."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).withColumn("log_date", F.to_date("occurred_at")).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return log.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()


def write_keyed(log: DataFrame, table: KeyedTable, checkpoint: str, writer: str = "stream", period: str | None = None) -> StreamingQuery:
    """Store each batch's rows of new ids in a keyed table: an id counts once, whichever batches bring it. Without a period: what is there now, then stop."""
    sink = log.writeStream.foreachBatch(lambda batch, number: table.append(batch, writer, number)).option("checkpointLocation", checkpoint)
    return (sink.trigger(processingTime=period) if period else sink.trigger(availableNow=True)).start()


def each_batch(log: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch function over what is there now, then stop."""
    return log.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
