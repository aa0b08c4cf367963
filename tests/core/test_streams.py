"""Streams with state: a keyed sink across batches, the upload queue with timers, sessions with late rows."""

from __future__ import annotations

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

from gridloom.operators import activity, records
from gridloom.sources.keyed import KeyedTable
from gridloom.streaming import log_stream, sessions, upload_queue

DAY = datetime.datetime(2026, 10, 5, 8)
COLUMNS = "id string, occurred_at timestamp, session_id string, action string"


def put(spark, folder, name, rows):
    """A file that the stream finds next."""
    frame = spark.createDataFrame([(i, DAY + datetime.timedelta(minutes=m), s, a) for i, m, s, a in rows], COLUMNS)
    frame.coalesce(1).write.json(str(folder / "new" / name))
    (folder / "in").mkdir(exist_ok=True)
    part = next((folder / "new" / name).glob("part-*.json"))
    part.rename(folder / "in" / f"{name}.json")


def stream(spark, folder):
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).json(str(folder / "in"))


def test_ids_of_two_batches_are_stored_once(spark, tmp_path):
    week = 7 * 24 * 60
    table = KeyedTable(spark, str(tmp_path / "table"), order="occurred_at", buckets=8)
    run = lambda: log_stream.write_keyed(stream(spark, tmp_path), table, str(tmp_path / "c")).awaitTermination()
    put(spark, tmp_path, "a", [("1", 0, "s", "first"), ("1", 1, "s", "again"), ("2", 2, "s", "first"), (None, 3, "s", "none")])
    run()
    put(spark, tmp_path, "b", [("2", week, "s", "late copy"), ("3", week, "s", "first")])
    run()
    want = {"1": "first", "2": "first", "3": "first"}
    rows = lambda: {r.id: r.action for r in table.read().collect()}
    assert rows() == want and table.read().count() == 3
    assert [c["without_id"] for c in table.manifest()["commits"]] == [1, 0]
    # killed after the table's commit, before the stream's own: the batch runs again and stores nothing
    commits = sorted((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for place in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        place.unlink(missing_ok=True)
    before = table.manifest()["version"]
    run()
    assert rows() == want and table.manifest()["version"] == before
    # killed between the files and the commit: the files count for nothing, and the next try stores them
    put(spark, tmp_path, "c", [("3", week + 1, "s", "copy"), ("4", week + 1, "s", "first")])
    publish = table.versions.publish
    table.versions.publish = lambda manifest: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(Exception, match="killed"):
        run()
    assert rows() == want
    table.versions.publish = publish
    run()
    assert rows() == want | {"4": "first"} and len(table.vacuum()) == 1
    assert rows() == want | {"4": "first"}
    table.compact()
    assert len(table.manifest()["commits"]) == 1 and rows() == want | {"4": "first"}
    table.vacuum()
    assert rows() == want | {"4": "first"}
    assert table.append(spark.createDataFrame([("4", DAY, "s", "x"), ("5", DAY, "s", "x")], COLUMNS)) == 1


def test_a_batch_reads_only_what_its_ids_touch(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=16)
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.current_timestamp().alias("occurred_at"), F.lit("s").alias("session_id"), F.lit("a").alias("action"))
    assert table.append(rows) == 20_000
    batch = spark.createDataFrame([("77",), ("new",)], "id string").withColumn("bucket_", table._bucket())
    touched = sorted({r.bucket_ for r in batch.collect()})
    known = table._with_bloom_pushdown(lambda: table.known(batch, touched))
    assert {int(f.split("bucket_=")[1].split("/")[0]) for f in known.inputFiles()} == set(touched)  # folders of other buckets aren't opened
    assert [r.id for r in known.collect()] == ["77"]
    absent = table._with_bloom_pushdown(lambda: table.read().where(F.col("id").isin("new", "newer")))
    assert absent.collect() == []
    scans = absent._jdf.queryExecution().executedPlan().collectLeaves()
    assert scans.apply(0).metrics().apply("numOutputRows").value() == 0  # the Bloom filters skip every row group


def _queue_log(seed, keys, n):
    rng = random.Random(seed)
    actions = ["enqueue", "start", "start", "fail", "retry", "auth", "shared", "private", "cancel", "missing"]
    at, rows = 0, []
    for k in range(n):
        at += rng.choice([1, 1, 2, 5, 40])
        rows.append((str(k), at, f"k{rng.randrange(keys)}", rng.choice(actions)))
    return rows


def test_queue_with_timers_is_the_same_after_a_restart(spark, tmp_path):
    stuck, idle = 10 * 60_000, 300 * 60_000
    log = _queue_log(5, 6, 120)
    end = log[-1][1] + 10_000  # far beyond, so that the watermark passes all
    log.append(("end", end, "end", "enqueue"))
    rng = random.Random(1)
    files = [log[k : k + 40] for k in range(0, len(log), 40)]
    got = {}
    for name, cuts in (("whole", [files]), ("restarted", [files[:1], files[1:2], files[2:]])):
        folder = tmp_path / name
        seen = got[name] = []
        for part in cuts:
            for rows in part:
                rows = rows[:]
                rng.shuffle(rows)
                put(spark, folder, f"f{rows[0][0]}-{len(seen)}-{rng.random()}", rows)
            # a new query each time: nothing but the checkpoint is kept
            states = upload_queue.queue_states(stream(spark, folder), "session_id", stuck=stuck, idle=idle, delay="1 minute")
            take = lambda b, n, seen=seen: seen.extend(b.collect())
            states.writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start().awaitTermination()
        assert not [r for r in seen if r.kind == "late"]
    last = {}
    for name, rows in got.items():
        last[name] = {r.key: (r.state, r.retries, r.recovered) for r in sorted(rows, key=lambda r: r["at"]) if r.kind == "expired"}
        assert all(r.kind == "expired" for r in rows if r["at"] == max(x["at"] for x in rows if x.key == r.key) and r.key != "end")
    table = spark.createDataFrame([(s, m * 60_000, a) for _, m, s, a in log], "key string, at bigint, action string")
    want = {r.key: (r.state, r.retries, r.recovered) for r in records.timed_states(table, "key", "at", "action", F.lit((end - 1) * 60_000), stuck, idle).collect() if r.key != "end"}
    assert last["whole"] == last["restarted"] == want and sum(x[2] for x in want.values()) > 0


def test_late_events_of_the_queue_are_told(spark, tmp_path):
    run = lambda seen: upload_queue.queue_states(stream(spark, tmp_path), "session_id", delay="1 minute").writeStream.foreachBatch(lambda b, n: seen.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    seen = []
    put(spark, tmp_path, "a", [("1", 0, "x", "enqueue"), ("2", 5, "x", "start"), ("3", 50, "y", "enqueue")])
    run(seen)
    put(spark, tmp_path, "b", [("4", 2, "x", "shared"), ("5", 60, "x", "retry")])
    run(seen)
    states = [(r.state, r.recovered) for r in seen if r.key == "x" and r.kind == "state"]
    assert [r.state for r in seen if r.kind == "late"] == ["shared"]
    assert states[0] == ("Pending", 1)  # the upload begun at 5 was interrupted 30 minutes later, which the watermark (49) has passed


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(9)
    rows = [(str(k), rng.randrange(600), f"s{rng.randrange(5)}", "run") for k in range(200)]
    rows.sort(key=lambda r: r[1] + rng.randrange(60))  # out of order by less than the delay
    files = [rows[k : k + 50] for k in range(0, len(rows), 50)]
    late = [("late1", 1, "s0", "run"), ("late2", 2, "s9", "run")]
    for n, part in enumerate([*files, late, [("end", 100_000, "end", "run")]]):
        put(spark, tmp_path, f"f{n}", part)
        made = sessions.session_stream(stream(spark, tmp_path), gap_minutes=7, delay="1 hour")
        sessions.write_sessions(made, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    dropped = read("late").groupBy("key").count().collect()
    assert {(r.key, r["count"]) for r in dropped} == {("s0", 1), ("s9", 1)}
    table = spark.createDataFrame([(i, DAY + datetime.timedelta(minutes=m), s, a) for i, m, s, a in rows], COLUMNS)
    want = {tuple(r) for r in activity.sessionize(table, "session_id", "occurred_at", 7).select("session_id", "first_at", "last_at", "events").collect()}
    got = [tuple(r)[:4] for r in read("sessions").select("key", "first_at", "last_at", "events").collect()]
    assert set(got) == want and len(got) == len(want) and sum(g[3] for g in got) == len(rows)


def test_sliding_windows_count_dropped_rows(spark, tmp_path):
    put(spark, tmp_path, "a", [(str(k), k, "s", "run") for k in range(30)])
    put(spark, tmp_path, "b", [("x", 500, "s", "run")])
    put(spark, tmp_path, "c", [("late", 1, "s", "run"), ("y", 501, "s", "run")])
    rows = stream(spark, tmp_path).withColumns({"tool_id": F.col("session_id"), "success": F.lit(True)})
    seen = []
    rates = log_stream.error_rates(rows, window="10 minutes", slide="5 minutes", delay="10 minutes")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", upload_queue.ROCKSDB)
    query = rates.writeStream.outputMode("append").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sessions.dropped_rows(query) >= 1
    counts = {(r.window_start - DAY).total_seconds() // 60: r.total for r in seen}
    assert counts == {-5: 5, 0: 10, 5: 10, 10: 10, 15: 10, 20: 10, 25: 5}
    shutil.rmtree(tmp_path / "c1")
