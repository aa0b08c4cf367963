"""Keyed records: upsert, history search, recent files, autosaves and the upload queue's states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.rounds import numbered, publish

# fixed values: the states of an upload
STATES = ["LocalOnly", "Pending", "Uploading", "UploadedPrivate", "UploadedShared", "Failed", "AuthenticationRequired"]
GROUPS = {
    "Uploaded": ["UploadedPrivate", "UploadedShared"],
    "NotUploaded": ["LocalOnly", "Pending", "Uploading"],
    "Failed": ["Failed", "AuthenticationRequired"],
}
RETRYABLE = ["Failed", "Pending", "AuthenticationRequired"]
RECENT_FILES = 20


def latest(records: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key: a grouped maximum, pre-aggregated before the shuffle."""
    names = records.columns
    rows = records.groupBy(key).agg(F.max_by(F.struct(*names), F.col(version)).alias("row_"))
    return rows.select(*(F.col(f"row_.{c}").alias(c) for c in names))


def upsert(store: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """changes replace or extend the store; of several changes to a key the newest counts."""
    newest = latest(changes, key, version)
    return store.join(newest.select(key), key, "left_anti").select(*store.columns).unionByName(newest.select(*store.columns))


def remove(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")


def valid(records: DataFrame, key: str, name: str, sizes: list[str]) -> DataFrame:
    """records with `valid`: a key, a name that isn't blank, no negative size."""
    good = F.col(key).isNotNull() & (F.trim(F.coalesce(F.col(name), F.lit(""))) != "")
    for c in sizes:
        good = good & (F.coalesce(F.col(c), F.lit(0)) >= 0)
    return records.withColumn("valid", good)


def history(records: DataFrame, term: str = "", group: str | None = None, name: str = "display_name", state: str = "upload_state", at: str = "created_at") -> DataFrame:
    """Records whose name contains term (any case) in a group of states, newest first."""
    rows = records.where(F.contains(F.upper(name), F.lit(term.upper()))) if term else records
    rows = rows.where(F.col(state).isin(GROUPS[group])) if group else rows
    return rows.orderBy(F.col(at).desc())


def can_retry(state: Column) -> Column:
    return state.isin(RETRYABLE)


# fixed values: what an event makes of a state; enqueue and retry make any state Pending, all others change nothing
MOVES = {
    ("Pending", "start"): "Uploading", ("Pending", "missing"): "Failed", ("Uploading", "cancel"): "Pending", ("Uploading", "shared"): "UploadedShared",
    ("Uploading", "private"): "UploadedPrivate", ("Uploading", "fail"): "Failed", ("Uploading", "auth"): "AuthenticationRequired",
}
RESTARTS = ("enqueue", "retry")


def next_state(state: Column, event: Column) -> Column:
    """The state after an event: enqueue, retry, start, shared, private, fail, auth, cancel, missing."""
    out = F.when(event.isin(*RESTARTS), "Pending")
    for (before, name), after in MOVES.items():
        out = out.when((state == before) & (event == name), after)
    return out.otherwise(state)


#: Events of a key that meet in one row.
_EVENTS_AT_ONCE = 10_000


def queue_states(events: DataFrame, key: str, at: str, event: str, at_once: int = _EVENTS_AT_ONCE) -> DataFrame:
    """The state and number of retries of each key after all its events, in time order (of one time, by name).

    A key's events meet in one row if they are few. Those of a key with more are cut into runs: what a run makes of each state is a table of
    as many entries as there are states, and such tables follow each other like the events themselves, so no row holds more than `at_once` events or runs.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(event).alias("event")))), lambda s: s["event"])
    first = F.struct(F.lit(STATES[0]).alias("state"), F.lit(0).alias("retries"))
    step = lambda acc, e: F.struct(next_state(acc["state"], e).alias("state"), (acc["retries"] + (e == "retry").cast("int")).alias("retries"))
    hot = publish(events.groupBy(F.col(key).alias("key_")).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > at_once).select("key_"), "hot-keys")
    if hot.isEmpty():
        return events.groupBy(key).agg(F.aggregate(ordered, first, step).alias("s")).select(key, "s.state", "s.retries")
    is_hot = F.col(key).eqNullSafe(F.col("key_"))
    few = events.join(hot, is_hot, "left_anti").groupBy(key).agg(F.aggregate(ordered, first, step).alias("s")).select(key, "s.state", "s.retries")
    placed = numbered(events.join(hot, is_hot, "left_semi").select(key, at, event), [key], [at, event], "n_").withColumn("run_", F.floor((F.col("n_") - 1) / at_once))
    every = F.array(*map(F.lit, STATES))
    start = F.struct(every.alias("states"), F.lit(0).alias("retries"))
    run = lambda acc, e: F.struct(F.transform(acc["states"], lambda s: next_state(s, e)).alias("states"), (acc["retries"] + (e == "retry").cast("int")).alias("retries"))
    runs = placed.groupBy(key, "run_").agg(F.aggregate(ordered, start, run).alias("made_"))
    in_turn = F.transform(F.array_sort(F.collect_list(F.struct("run_", "made_"))), lambda x: x["made_"])
    after = lambda acc, made: F.struct(made["states"][F.array_position(every, acc["state"]).cast("int") - 1].alias("state"), (acc["retries"] + made["retries"]).alias("retries"))
    many = runs.groupBy(key).agg(F.aggregate(in_turn, first, after).alias("s")).select(key, "s.state", "s.retries")
    return few.unionByName(many)


def timed_states(events: DataFrame, key: str, at: str, event: str, now: Column, stuck: int, idle: int) -> DataFrame:
    """The state of each key at a time, when time acts too (all in milliseconds): key, state, retries, recovered, expired.

    An upload under way for `stuck` was interrupted and is pending again (recovered counts that); a key without an event for `idle` is
    forgotten, so that a later event finds it new. A key's own events meet in one row, as in `queue_states`.
    """
    start = F.struct(F.lit(STATES[0]).alias("state"), F.lit(0).alias("retries"), F.lit(0).alias("recovered"), F.lit(-1).cast("bigint").alias("since"), F.lit(-1).cast("bigint").alias("last"))

    def pass_time(acc: Column, upto: Column) -> Column:
        due = (acc["state"] == "Uploading") & (acc["since"] + stuck <= upto)
        changed = {"state": F.when(due, "Pending").otherwise(acc["state"]), "recovered": acc["recovered"] + due.cast("int"), "since": F.when(due, acc["since"] + stuck).otherwise(acc["since"])}
        return F.struct(*(changed.get(c, acc[c]).alias(c) for c in ("state", "retries", "recovered", "since", "last")))

    def step(acc: Column, e: Column) -> Column:
        forgotten = (acc["last"] >= 0) & (acc["last"] + idle <= e["at"])
        before = pass_time(F.when(forgotten, start).otherwise(acc), e["at"])
        after = next_state(before["state"], e["event"])
        entered = (after != before["state"]) | e["event"].isin(*RESTARTS)
        return F.struct(
            after.alias("state"), (before["retries"] + (e["event"] == "retry").cast("int")).alias("retries"), before["recovered"].alias("recovered"),
            F.when(entered, e["at"]).otherwise(before["since"]).alias("since"), e["at"].alias("last"),
        )

    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).cast("bigint").alias("at"), F.col(event).alias("event"))))
    rows = events.where(F.col(at) <= now).groupBy(key).agg(F.aggregate(ordered, start, step).alias("s"))
    end = F.col("s.last") + idle
    rows = rows.select(key, end.alias("end"), pass_time(F.col("s"), F.least(now, end)).alias("s"))
    return rows.select(key, "s.state", "s.retries", "s.recovered", (F.col("end") <= now).alias("expired"))


def recover(records: DataFrame, state: str = "upload_state") -> DataFrame:
    """After a restart, uploads that were under way are pending again."""
    return records.withColumn(state, F.when(F.col(state) == "Uploading", "Pending").otherwise(F.col(state)))


def recent_files(files: DataFrame, path: str, at: str, limit: int = RECENT_FILES, kind: str | None = None, of: str | None = None) -> DataFrame:
    """The newest opening of each path (any case), newest first; only those whose column `kind` is `of`, if given."""
    if kind:  # the list holds so many files of all kinds, and the filter looks at these
        rows = files.groupBy(F.upper(path).alias("path_")).agg(F.max_by(F.struct(path, kind), at).alias("file_"), F.max(at).alias(at))
        listed = rows.select(f"file_.{path}", f"file_.{kind}", at).orderBy(F.col(at).desc(), path).limit(limit)
        return listed.where(F.col(kind) == of).orderBy(F.col(at).desc(), path)
    rows = files.groupBy(F.upper(path).alias("path_")).agg(F.max_by(path, at).alias(path), F.max(at).alias(at))
    return rows.drop("path_").orderBy(F.col(at).desc(), path).limit(limit)


def autosaves(saves: DataFrame, now: Column, days: int = 7, at: str = "saved_at") -> DataFrame:
    """Autosaves not older than some days, newest first."""
    return saves.where(F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS")).orderBy(F.col(at).desc())


def by_category(items: DataFrame, category: str, name: str) -> DataFrame:
    """Each category's names in order, such as a catalogue of functions or templates shows them."""
    return items.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("names"))


def of_kind(items: DataFrame, kind: str, value: str | None = None) -> DataFrame:
    """Items, such as templates, of one kind, or all of them."""
    return items if value is None else items.where(F.col(kind) == value)


def by_id(items: DataFrame, key: str, value: object, order: str) -> DataFrame:
    """The first item by `order` that has this id; no row if none has it."""
    return items.where(F.col(key) == F.lit(value)).orderBy(order).limit(1)


def age_label(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60e6)
    return (
        F.when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h")))
        .when(minutes < 10080, F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d")))
        .otherwise(F.date_format(then, "dd/MM/yyyy"))
    )


def bounds(points: Column) -> Column:
    """Left, top, right and bottom of an array of structs x, y."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))


def translate(points: Column, dx: float, dy: float) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


#: Copies of a name that meet the free numbers of their family in one band.
_NAME_BAND = 1024
#: A name's extension: from its last point on, unless the name begins with that.
_EXTENSION = r"(?<=.)\.[^.]*$"


def unique_names(files: DataFrame, name: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """files with unique_name: no two are equal in any case, nor equal to one of `existing` (a column `name`).

    The first by order of each name keeps it, unless it exists. Its copies get -2, -3, ... before the extension, in turn the numbers
    that no existing and no other wanted name has. The numbers taken are islands; the n-th copy finds the gap between them that holds the
    n-th free number, by bands of copies, so neither a name with many copies nor one with many numbers meets in one task.
    """
    upper = F.upper(F.col(name))
    wanted = files.select(upper.alias("key_")).distinct()
    taken = wanted if existing is None else wanted.unionByName(existing.select(F.upper("name").alias("key_"))).distinct()
    rows = numbered(files.withColumn("key_", upper), ["key_"], [order, name], "copy_")
    if existing is not None:
        old = existing.select(F.upper("name").alias("key_")).distinct().withColumn("old_", F.lit(1))
        rows = rows.join(old, "key_", "left").withColumn("copy_", F.col("copy_") + F.coalesce("old_", F.lit(0))).drop("old_")
    gaps = _gaps(taken, rows.groupBy("key_").agg(F.max("copy_").alias("copies_")).where("copies_ > 1"))
    copies = rows.where("copy_ > 1").withColumn("band_", F.floor(F.col("copy_") / _NAME_BAND))
    found = copies.join(gaps, ["key_", "band_"]).where(F.col("copy_").between(F.col("first_"), F.col("last_")))
    stem, ext = F.regexp_replace(name, _EXTENSION, ""), F.regexp_extract(name, _EXTENSION, 0)
    renamed = found.withColumn("unique_name", F.concat(stem, F.lit("-"), (F.col("copy_") + F.col("shift_")).cast("string"), ext))
    kept = rows.where("copy_ = 1 or key_ is null").withColumn("unique_name", F.col(name))
    return kept.select(*files.columns, "unique_name").unionByName(renamed.select(*files.columns, "unique_name"))


def _gaps(taken: DataFrame, wanted: DataFrame) -> DataFrame:
    """Free numbers of names: key_, band_, first_ and last_ (copies that get one), shift_ (to add to a copy's number)."""
    key = F.col("key_")
    ext, whole = F.regexp_extract(key, _EXTENSION, 0), F.regexp_replace(key, _EXTENSION, "")
    number = F.regexp_extract(whole, r"-([1-9]\d{0,17})$", 1)
    numbers = taken.select(F.concat(F.regexp_replace(whole, r"-\d+$", ""), ext).alias("key_"), F.when(number != "", number).try_cast("bigint").alias("number_")).where("number_ >= 2").distinct()
    placed = numbered(numbers.join(wanted, "key_", "left_semi"), ["key_"], ["number_"], "place_")
    # before the i-th taken number t there are t - 2 - (i - 1) free ones; copy c wants free number c - 1
    upto = placed.select("key_", F.col("place_").alias("shift_"), (F.col("number_") - F.col("place_")).alias("upto_"))  # copies up to upto_ stand before it
    following = upto.select("key_", (F.col("shift_") - 1).alias("shift_"), F.col("upto_").alias("next_"))  # as many as the one before, within an island
    after = upto.join(following, ["key_", "shift_"], "left").join(wanted, "key_").select("key_", "shift_", (F.col("upto_") + 1).alias("first_"), F.coalesce("next_", "copies_").alias("last_"))
    first = following.where("shift_ = 0").select("key_", "next_")
    start = wanted.join(first, "key_", "left").select("key_", F.lit(0).cast("bigint").alias("shift_"), F.lit(2).cast("bigint").alias("first_"), F.coalesce("next_", "copies_").alias("last_"))
    gaps = after.unionByName(start).join(wanted, "key_").withColumn("last_", F.least("last_", "copies_")).where("first_ <= last_")
    return gaps.withColumn("band_", F.explode(F.sequence(F.floor(F.col("first_") / _NAME_BAND), F.floor(F.col("last_") / _NAME_BAND)))).drop("copies_")


def safe_name(name: Column) -> Column:
    return F.translate(name, '\\/:*?"<>|', "_________")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that a root reaches over edges (src, dst); roots: node. One join a round, only the new nodes go on, until there are none."""
    found = publish(roots.select("node").distinct())
    fresh = found
    while not fresh.isEmpty():
        step = edges.join(fresh.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        fresh = publish(step.join(found, "node", "left_anti"))
        found = publish(found.unionByName(fresh))
    return found


def layers_after(commands: DataFrame, key: str = "doc_id", at: str = "at", limit: int = 100) -> DataFrame:
    """The layers of each document after its commands, in time order: key, layers (layer, x, y, bottom first).

    commands: key, at, action (add, delete, move, clear, undo, redo), layer, dx, dy. Undo takes back the last command, up to
    `limit` of them; a new command ends what can be redone. A document's own commands meet in one row.
    """
    events = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "action", "layer", "dx", "dy"))), lambda e: e)
    numbers = F.array().cast("array<int>")

    def turn(acc: Column, k: Column) -> Column:
        action, applied, redo = F.col("events")[k]["action"], acc["applied"], acc["redo"]
        undoes, redoes = (action == "undo") & (acc["depth"] > 0), (action == "redo") & (F.size(redo) > 0)
        does, drop = ~action.isin("undo", "redo"), lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
        last = lambda a: F.try_element_at(a, F.lit(-1))
        return F.struct(
            F.when(undoes, drop(applied)).when(redoes, F.array_append(applied, last(redo))).when(does, F.array_append(applied, k)).otherwise(applied).alias("applied"),
            F.when(undoes, F.array_append(redo, last(applied))).when(redoes, drop(redo)).when(does, numbers).otherwise(redo).alias("redo"),
            F.when(undoes, acc["depth"] - 1).when(redoes, acc["depth"] + 1).when(does, F.least(acc["depth"] + 1, F.lit(limit))).otherwise(acc["depth"]).alias("depth"),
        )

    none = F.array().cast("array<struct<layer:string,x:double,y:double>>")

    def draw(layers: Column, k: Column) -> Column:
        e = F.col("events")[k]
        layer = lambda x, y: F.struct(e["layer"].cast("string").alias("layer"), x.cast("double").alias("x"), y.cast("double").alias("y"))
        moved = F.transform(layers, lambda a: F.when(a["layer"] == e["layer"].cast("string"), layer(a["x"] + e["dx"], a["y"] + e["dy"])).otherwise(a))
        others = F.filter(layers, lambda a: a["layer"] != e["layer"].cast("string"))
        return (
            F.when(e["action"] == "add", F.array_append(layers, layer(F.coalesce(e["dx"], F.lit(0.0)), F.coalesce(e["dy"], F.lit(0.0)))))
            .when(e["action"] == "delete", others).when(e["action"] == "move", moved).when(e["action"] == "clear", none).otherwise(layers)
        )

    rows = commands.groupBy(key).agg(events.alias("events"))
    places = F.sequence(F.lit(0), F.size("events") - 1)
    start = F.struct(numbers.alias("applied"), numbers.alias("redo"), F.lit(0).alias("depth"))
    rows = rows.withColumn("applied", F.aggregate(places, start, turn, lambda acc: acc["applied"]))
    return rows.select(key, F.aggregate("applied", none, draw).alias("layers"))
