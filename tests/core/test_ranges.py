"""Rectangles, versions of a sheet, clustered logs, names and word wrap, held against plain loops."""

from __future__ import annotations

import datetime
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from gridloom.functions import aggregates as A
from gridloom.operators import pages, records
from gridloom.operators import rectangles as X
from gridloom.operators.versions import CellHistory
from gridloom.plans import document_queries
from gridloom.sources import logs

CELLS = "sheet string, row bigint, col int, text string, num double"


def test_areas_and_blanks(spark):
    rng = random.Random(2)
    ranges = [(k % 4, "S", *(rng.randrange(1, 60) for _ in range(4))) for k in range(40)] + [(4, "S", 1, 3, 1_048_576, 3), (4, "S", 5, 1, 5, 9)]
    cells = sorted({(rng.randrange(1, 60), rng.randrange(1, 60)) for _ in range(700)} | {(70_000, 3), (1_048_576, 3), (300, 3)})
    frame = spark.createDataFrame([("S", r, c, "7" if r % 5 else "", 7.0 if r % 5 else None) for r, c in cells], CELLS)
    rects = spark.createDataFrame(ranges, "k int, sheet string, r1 int, c1 int, r2 int, c2 int")
    inside = lambda g, r, c: min(g[2], g[4]) <= r <= max(g[2], g[4]) and min(g[3], g[5]) <= c <= max(g[3], g[5])
    size = lambda g: (abs(g[2] - g[4]) + 1) * (abs(g[3] - g[5]) + 1)
    filled = [(r, c) for r, c in cells if r % 5]
    want = {k: sum(size(g) - sum(inside(g, *x) for x in filled) for g in ranges if g[0] == k) for k in range(5)}
    assert {r.k: r.blanks for r in X.countblank(frame, rects, ["k"]).collect()} == want
    for r in X.selection(frame, rects.where("k < 4"), ["k"]).collect():
        mine = [g for g in ranges if g[0] == r.k]
        union = {(a, b) for a in range(1, 60) for b in range(1, 60) if any(inside(g, a, b) for g in mine)}
        some = [x for x in filled if x in union]
        assert (r.places, r.filled, r["sum"]) == (len(union), len(some), 7.0 * len(some))
    whole = X.selection(frame, rects.where("k = 4"), ["k"]).first()
    assert (whole.places, whole.filled) == (1_048_576 + 8, sum(any(inside(g, *x) for g in ranges[-2:]) for x in filled))
    assert X.pieces(rects.where("k = 4"), ["sheet"]).count() == 3  # above row 5, row 5, below it


def test_styles_over_a_whole_column(spark):
    styles = spark.createDataFrame([("S", 2, 1, False, "x"), ("S", 2, 2, False, "y"), ("T", 2, 1, False, "z")], "sheet string, row bigint, col int, bold boolean, format string")
    out = X.apply_style(styles, X.rectangles(spark, "S", [(1, 1, 200_000, 1), (100, 1, 3, 1)]), bold=True)
    assert out.count() == 200_000 + 2 and out.where("bold").count() == 200_000
    assert {(r.sheet, r.col, r.bold) for r in out.where("format is not null").collect()} == {("S", 1, True), ("S", 2, False), ("T", 1, False)}
    assert out.where("bold").rdd.getNumPartitions() > 1


def test_blocks_above(spark):
    rows = [("S", r, 1, str(r), float(r)) for r in (1, 2, 3, 5, 6, 8)] + [("S", 9, 1, "x", None), ("S", 2, 2, "4", 4.0)]
    cells = spark.createDataFrame(rows, CELLS)
    targets = spark.createDataFrame([("S", 4, 1), ("S", 7, 1), ("S", 9, 1), ("S", 12, 1), ("S", 6, 1), ("S", 3, 2), ("S", 1, 2)], "sheet string, row bigint, col int")
    got = {(r.row, r.col): (r.value, r.first_row) for r in X.aggregate_block(cells, targets, A.SUM).collect()}
    # row 6 is a target itself, so the block above row 7 is gone
    assert got == {(4, 1): (6.0, 1), (7, 1): (0.0, None), (9, 1): (8.0, 8), (12, 1): (0.0, None), (6, 1): (5.0, 5), (3, 2): (4.0, 2), (1, 2): (0.0, None)}
    above = {(r.row, r.col): r.value for r in X.aggregate_above(cells, targets, A.MAX).collect()}
    assert above == {(4, 1): 3.0, (7, 1): 6.0, (9, 1): 8.0, (12, 1): 8.0, (6, 1): 5.0, (3, 2): 4.0}


def test_all_above(spark):
    """Against plain loops; and rows that meet grow with the numbers, not with numbers times targets."""
    rng = random.Random(6)
    places = {(rng.choice("ST"), rng.randrange(1, 300), rng.randrange(1, 4)): rng.randrange(-50, 50) for _ in range(900)}
    cells = spark.createDataFrame([(s, r, c, str(v), None if v % 9 == 0 else float(v)) for (s, r, c), v in places.items()], CELLS).repartition(5)
    asked = {(rng.choice("STU"), rng.randrange(1, 320), rng.randrange(1, 6)) for _ in range(300)}
    targets = spark.createDataFrame([*asked, *list(asked)[:9]], "sheet string, row int, col int")
    plain = {A.SUM: sum, A.AVERAGE: lambda x: sum(x) / len(x), A.COUNT: len, A.MIN: min, A.MAX: max, A.MEDIAN: statistics.median}
    for function, want in plain.items():
        rows = X.aggregate_above(cells, targets, function)
        assert rows.dtypes == [("sheet", "string"), ("row", "int"), ("col", "int"), ("value", "double")] or function is A.MEDIAN
        got = {(r.sheet, r.row, r.col): r.value for r in rows.collect()}
        assert set(got) == {p for p in asked if p[1] > 1} and rows.count() == len(got)
        for (s, row, col), value in got.items():
            above = [float(v) for (t, r, c), v in places.items() if (t, c) == (s, col) and r < row and v % 9]
            assert value == pytest.approx(want(above) if above else 0.0, abs=1e-9)


def _most_rows(node):
    """The most rows that a node of a plan that has run put out."""
    kind, made, children = node.getClass().getSimpleName(), node.metrics().get("numOutputRows"), node.children()
    below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in kind else [children.apply(k) for k in range(children.size())]
    return max([made.get().value() if made.isDefined() else 0, *map(_most_rows, below)])


def test_all_above_reads_a_number_once(spark):
    key = F.col("id")
    cells = spark.range(1, 4001).select(F.lit("S").alias("sheet"), key.alias("row"), F.lit(1).alias("col"), key.cast("string").alias("text"), key.cast("double").alias("num"))
    above = X.aggregate_above(cells, cells.where("row % 2 = 0").select("sheet", "row", "col"), A.SUM)
    rows = above.collect()
    assert len(rows) == 2000 and all(r.value == r.row * (r.row - 1) / 2 for r in rows)
    assert _most_rows(above._jdf.queryExecution().executedPlan()) <= 6000  # numbers and targets, not pairs of them


def test_plain_text_of_runs_and_blocks(spark):
    """A table of runs in any order, nulls among them, against a plain loop, and the same from blocks that carry their runs."""
    rng = random.Random(9)
    runs = [(d, b, r, rng.choice(["", "a", "ß c", None, "\n"]), "PageBreak" if (d + b) % 4 == 3 else None if b == 1 else "Paragraph") for d in range(6) for b in (0, 1, 2, 11) for r in range(rng.randrange(1, 5))]
    rng.shuffle(runs)
    frame = spark.createDataFrame(runs, "doc_id int, block_no int, run_no int, text string, kind string").repartition(3)
    want, blocks = {}, {}
    for d, b, _, text, kind in sorted(runs, key=lambda x: x[:3]):
        blocks.setdefault((d, b), (kind, []))[1].append(text)
    for (d, _), (kind, texts) in blocks.items():
        want[d] = want.get(d, "") + ("\n--- PAGE BREAK ---\n\n" if kind == "PageBreak" else "".join(t or "" for t in texts) + "\n")
    assert {r.doc_id: r.text for r in pages.plain_text(frame).collect()} == want
    nested = spark.createDataFrame([(d, b, kind, texts) for (d, b), (kind, texts) in blocks.items()], "doc_id int, block_no int, kind string, runs array<string>")
    assert {r.doc_id: r.text for r in pages.plain_text(nested).collect()} == want
    empty = nested.limit(1).select(F.lit(1).alias("doc_id"), F.lit(0).alias("block_no"), F.lit("Paragraph").alias("kind"), F.lit(None).cast("array<string>").alias("runs"))
    assert [r.text for r in pages.plain_text(empty).collect()] == ["\n"]


def test_plain_text_makes_a_row_per_block(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = docs.select(F.sum(F.size(F.split("text", "\n")))).first()[0]
    shown = document_queries.page_plain_text(spark, "/root/testdata/sf0.001")
    assert len(shown.collect()) == docs.where("text is not null").count()
    assert _most_rows(shown._jdf.queryExecution().executedPlan()) <= lines  # and not one per run


def test_history_of_a_sheet(spark, tmp_path):
    """Against lists of snapshots, with a short limit."""
    rng = random.Random(8)
    frame = lambda values: spark.createDataFrame([("S", r, c, t) for (r, c), t in values.items()], "sheet string, row bigint, col int, text string")
    now = {(r, c): f"{r}" for r in range(4) for c in range(3)}
    history = CellHistory(spark, str(tmp_path / "h"), limit=4)
    with pytest.raises(FileNotFoundError):
        history.read()
    history.begin(frame(now))
    past, future, versions = [], [], {0: now}
    for action in [*"eeueeruurre", *"eeeeuuuuuurrr"]:
        if action == "e":
            values = {(rng.randrange(5), rng.randrange(3)): rng.choice(["", "a", "7"]) for _ in range(3)}
            past, future = [*past, now][-4:], []
            now = {k: t for k, t in (now | values).items() if t}
            versions[history.edit(frame(values))] = now
        elif action == "u":
            assert history.undo() == bool(past)
            if past:
                future.append(now)
                now = past.pop()
        else:
            assert history.redo() == bool(future)
            if future:
                past.append(now)
                now = future.pop()
        assert {(r.row, r.col): r.text for r in history.read().collect()} == now
    kept = history.versions()
    assert len(kept) == 5
    for version in kept:
        assert {(r.row, r.col): r.text for r in history.read(version).collect()} == versions[version]
    old, new = kept[1], kept[3]
    changed = {(r.row, r.col): (r.before, r.after) for r in history.difference(old, new).collect()}
    a, b = versions[old], versions[new]
    assert changed == {k: (a.get(k, ""), b.get(k, "")) for k in {*a, *b} if a.get(k, "") != b.get(k, "")}
    depth = lambda v: history.read(v)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert depth(kept[1]) == depth(kept[-1])  # the plan doesn't grow with the edits
    history.vacuum()
    assert {(r.row, r.col): r.text for r in history.read(kept[-1]).collect()} == versions[kept[-1]]
    with pytest.raises(KeyError):
        history.read(0)


def test_clustered_log_skips_what_is_not_asked_for(spark, tmp_path):
    day = datetime.datetime(2026, 10, 1, 8)
    rows = spark.range(60_000).select(
        F.col("id").cast("string").alias("id"), (F.lit(day) + F.make_dt_interval(days=(F.col("id") % 3).cast("int"))).alias("occurred_at"), F.md5((F.col("id") % 500).cast("string")).alias("session_id"),
        F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("tool_id"), F.sha2(F.col("id").cast("string"), 256).alias("message"),
    )
    path = str(tmp_path / "log")
    logs.write_clustered(rows, path, block_bytes=1 << 17)
    log = logs.read_clustered(spark, path)
    assert log.count() == 60_000

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan = plan.finalPhysicalPlan()
        metrics = plan.collectLeaves().apply(0).metrics()
        return metrics.apply("numOutputRows").value(), metrics.apply("numFiles").value()

    session = log.where(F.col("session_id") == F.md5(F.lit("77"))).select("id")
    assert session.count() == 120 and scanned(session)[0] < 30_000  # row groups of other sessions are skipped
    assert scanned(log.where("session_id = 'none of them'").select("id"))[0] == 0
    one_tool = log.where("log_date = date '2026-10-02' and tool_id = 't3'").select("id")
    assert scanned(one_tool)[0] < 10_000
    # an expired day goes by its name: a damaged file there does no harm
    expired = tmp_path / "log" / "log_date=2026-10-01"
    (expired / "part-damaged.parquet").write_bytes(b"no parquet")
    assert logs.drop_expired(spark, path, datetime.date(2026, 10, 4), 2) == ["log_date=2026-10-01"]
    assert logs.read_clustered(spark, path).count() == 40_000


def _plain_names(names, existing):
    taken, seen, made, out = {n.upper() for n in (*names, *existing)}, {n.upper() for n in existing}, set(), []
    for name in names:
        if name.upper() not in seen:
            seen.add(name.upper())
            out.append(name)
            continue
        found = re.search(r"(?<=.)\.[^.]*$", name)
        stem, ext = (name[: found.start()], found[0]) if found else (name, "")
        k = 2
        while f"{stem}-{k}{ext}".upper() in taken | made:
            k += 1
        made.add(f"{stem}-{k}{ext}".upper())
        out.append(f"{stem}-{k}{ext}")
    return out


def test_unique_names(spark, monkeypatch):
    monkeypatch.setattr(records, "_NAME_BAND", 4)
    rng = random.Random(4)
    pool = ["a.png", "A.png", "a-2.png", "a-3.png", "a-5.PNG", ".env", "b", "B", "b-2", "a-02.png", "x.tar.gz", "a-2-2.png", "a-9.png"]
    for names, existing in ((["a.png", "A.png", "a-2.png", ".env", ".ENV"], []), ([rng.choice(pool) for _ in range(80)], ["A-4.png", "B", "b-3", "zz"])):
        frame = spark.createDataFrame(list(enumerate(names)), "k int, n string").repartition(3)
        got = [r.unique_name for r in records.unique_names(frame, "n", "k", spark.createDataFrame([(e,) for e in existing], "name string")).orderBy("k").collect()]
        assert got == _plain_names(names, existing) and len({x.upper() for x in (*got, *existing)}) == len(names) + len(existing)


def _plain_wrap(text, width, limit):
    lines = []
    for paragraph in text.split("\n"):
        line = ""
        for word in paragraph.replace("\t", "    ").split(" "):
            longer = word if not line else f"{line} {word}"
            if sum(map(width, longer)) <= limit:
                line = longer
                continue
            if line:
                lines.append(line)
            line = ""
            for c in word:
                if line and sum(map(width, line + c)) > limit:
                    lines.append(line)
                    line = ""
                line += c
        lines.append(line)
    return lines


def test_wrap_by_widths(spark):
    rng = random.Random(6)
    texts = ["", " ", "\n", "a\tb", *("".join(rng.choice("ab  iiWW\tếx\n") for _ in range(rng.randrange(60))) for _ in range(60))]
    font = pages.Font({"i": 200, "W": 950, " ": 250, "ế": 500}, 480)
    width = lambda c: {"i": 200, "W": 950, " ": 250, "ế": 480}.get(c, 480)  # noqa: E731  ế lies beyond the table
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for limit, size in ((24.0, 10.0), (5.0, 10.0), (1.0, 10.0)):
        got = {r.k: r.lines for r in frame.select("k", pages.wrap(F.col("t"), limit, font, size).alias("lines")).collect()}
        assert got == {k: _plain_wrap(t, width, limit * 1000 / size) for k, t in enumerate(texts)}


def test_searches_and_merges(spark):
    frame = spark.createDataFrame([(None, 2, "n"), (1, 1, "Straße"), (1, 3, "c.c"), (2, 1, "d")], "doc_id int, page_no int, text string")
    assert [(r.page_no, r.text) for r in pages.merge_documents(frame).orderBy("page_no").collect()] == [(1, "n"), (2, "Straße"), (3, "c.c"), (4, "d")]
    assert pages.find_text(frame, "").count() == 0 and pages.find_text(frame, "strasse").count() == 0
    assert [(r.text, r.hits) for r in pages.find_text(frame, "C").collect()] == [("c.c", 2)] and pages.find_text(frame, "C", True).count() == 0
    left = spark.createDataFrame([(1, 1, "a\nb\na\nc\na\n x ")], "doc_id int, page_no int, text string")
    right = spark.createDataFrame([(1, 1, "c\na\nnew\nx"), (1, 2, "p")], "doc_id int, page_no int, text string")
    got = {(r.page_no, r.side): (r.lines, r.more) for r in pages.compare_report(left, right, 2).collect()}
    assert got == {(1, "removed"): (["b", "a"], 1), (1, "added"): (["new"], 0), (2, "added"): (["p"], 0)}
