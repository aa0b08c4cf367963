"""The upload queue on a stream: a state machine per key with event-time timers.

Events of a key wait in list state until the watermark has passed them and are folded then, in order of their time, so
that neither the order in which they come nor the cut into micro-batches matters. Between two events time itself acts: an
upload under way for longer than `stuck` was interrupted and is pending again, and a key without an event for `idle` is
forgotten. `records.timed_states` does the same over a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.operators import records

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds that an upload may be under way, and that a key may be without an event.
STUCK, IDLE = 30 * 60_000, 7 * 24 * 3_600_000
SCHEMA = "key string, state string, retries int, recovered int, at timestamp, kind string"
_COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]


class Machine:
    """One key's state: name, retries, recovered, since (when it was entered) and last (its last event), in milliseconds."""

    def __init__(self, stuck: int, state: tuple | None = None):
        self.stuck = stuck
        self.name, self.retries, self.recovered, self.since, self.last = state or (records.STATES[0], 0, 0, -1, -1)

    def state(self) -> tuple:
        return self.name, self.retries, self.recovered, self.since, self.last

    def deadline(self) -> int | None:
        """When the upload under way counts as interrupted."""
        return self.since + self.stuck if self.name == "Uploading" else None

    def pass_time(self, now: int) -> bool:
        """What happens up to now without an event."""
        due = self.deadline()
        if due is None or due > now:
            return False
        self.name, self.since, self.recovered = "Pending", due, self.recovered + 1
        return True

    def event(self, at: int, action: str) -> None:
        self.pass_time(at)
        before = self.name
        self.name = "Pending" if action in records.RESTARTS else records.MOVES.get((before, action), before)
        self.retries += action == "retry"
        self.last = at
        if self.name != before or action in records.RESTARTS:
            self.since = at


class QueueProcessor(StatefulProcessor):
    def __init__(self, stuck: int, idle: int):
        self.stuck, self.idle = stuck, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, action string")
        self.machine = handle.getValueState("machine", "name string, retries int, recovered int, since bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            for at, action in zip(frame["at"].tolist(), frame["action"].tolist(), strict=True):
                if at <= passed and passed > 0:
                    late.append((key[0], action, None, None, at, "late"))
                else:
                    self.waiting.appendValue((at, action))
                    self.handle.registerTimer(at)
        yield _frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(x for x in waiting if x[0] <= now)
        known = self.machine.exists()
        if not known and not due:
            return
        machine = Machine(self.stuck, tuple(self.machine.get()) if known else None)
        before = machine.state()
        out = []
        for at, action in due:
            if machine.last >= 0 and machine.last + self.idle <= at:  # forgotten before this event came
                machine.pass_time(machine.last + self.idle)
                out.append(_row(key, machine, machine.last + self.idle, "expired"))
                machine = Machine(self.stuck)
            machine.event(at, action)
        end = machine.last + self.idle
        machine.pass_time(min(now, end))
        if due:
            rest = [x for x in waiting if x[0] > now]
            self.waiting.put(rest) if rest else self.waiting.clear()
        if machine.state() != before:
            out.append(_row(key, machine, max(machine.last, machine.since), "state"))
        if end <= now:
            out.append(_row(key, machine, end, "expired"))
            self.machine.clear()
        else:
            self.machine.update(machine.state())
            self.handle.registerTimer(end)
            if machine.deadline() is not None:
                self.handle.registerTimer(machine.deadline())
        yield _frame(out)

    def close(self) -> None:
        pass


def _row(key: tuple, machine: Machine, at: int, kind: str) -> tuple:
    return key[0], machine.name, machine.retries, machine.recovered, at, kind


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    return frame.astype({"retries": "Int32", "recovered": "Int32"}).assign(at=pd.to_datetime(frame["at"], unit="ms"))


def queue_states(events: DataFrame, key: str = "id", at: str = "occurred_at", action: str = "action", stuck: int = STUCK, idle: int = IDLE, delay: str = "10 minutes") -> DataFrame:
    """Changes of the queue's states: key, state, retries, recovered, at, kind (state; expired: the key's last state, forgotten at that time; late: an event, named in state, that came after the watermark).

    Sets this session's state store to RocksDB, which timers and list state need.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # without the column that the watermark is on, late rows come too, and the processor tells them
    rows = events.withWatermark(at, delay).select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(at)).alias("at"), F.col(action).alias("action"))
    rows = rows.where("key is not null and at is not null")
    return rows.groupBy("key").transformWithStateInPandas(QueueProcessor(stuck, idle), SCHEMA, "Append", "EventTime")
