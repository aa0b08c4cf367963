"""Sessions and sliding windows of a log stream, with the rows that came too late put aside.

A session is a run of a key's events with no more than `gap` between neighbours. Open sessions are list state; an event
opens one, extends one, or joins two that it stands between. When the watermark has passed a session's end by the gap no
event that isn't late can reach it any more, so it is given out, once. A row at or before the watermark is late and goes to
the side output as it is, so sessions and late rows together account for every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gridloom.streaming.upload_queue import ROCKSDB

SCHEMA = "key string, first_at timestamp, last_at timestamp, events bigint, kind string"
_COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]


def merged(sessions: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (first, last, events) in order, those no more than gap apart as one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(sessions):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class SessionProcessor(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first bigint, last bigint, events bigint")

    def _sessions(self) -> list[tuple[int, int, int]]:
        return [tuple(x) for x in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs(), []
        sessions = self._sessions()
        for frame in rows:
            places = frame["at"].tolist()
            late += [(key[0], at, at, 1, "late") for at in places if at <= passed and passed > 0]
            # merged frame by frame: what is held is the open sessions, not the events
            sessions = merged(sessions + [(at, at, 1) for at in places if at > passed or passed <= 0], self.gap)
        if sessions:
            self.open.put(sessions)
            for _, last, _ in sessions:
                self.handle.registerTimer(last + self.gap)
        yield _frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        sessions = self._sessions()
        done = [s for s in sessions if s[1] + self.gap <= now]
        if done:
            rest = [s for s in sessions if s[1] + self.gap > now]
            self.open.put(rest) if rest else self.open.clear()
        yield _frame([(key[0], *s, "session") for s in done])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    return frame.assign(**{c: pd.to_datetime(frame[c], unit="ms") for c in ("first_at", "last_at")})


def session_stream(log: DataFrame, key: str = "session_id", at: str = "occurred_at", gap_minutes: float = 30, delay: str = "1 hour") -> DataFrame:
    """Sessions as they end, and late rows as they come: key, first_at, last_at, events, kind (session or late). Times have milliseconds.

    Sets this session's state store to RocksDB, which list state needs.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # without the column that the watermark is on, late rows come too, and the processor tells them
    rows = log.withWatermark(at, delay).select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(at)).alias("at")).where("key is not null and at is not null")
    return rows.groupBy("key").transformWithStateInPandas(SessionProcessor(int(gap_minutes * 60_000)), SCHEMA, "Append", "EventTime")


def write_sessions(sessions: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Sessions to folder/sessions, late rows to folder/late, a folder per batch, which a batch that runs again replaces."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        for kind, name in (("session", "sessions"), ("late", "late")):
            rows.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        rows.unpersist()

    writer = sessions.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that a query's windows have left out because they came after the watermark, as far as its progress reports tell."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
