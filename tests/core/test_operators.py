"""Grid, page, record and log operators, files and streams."""

from __future__ import annotations

import datetime
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators import activity, grid, pages, records
from gridloom.sources import delimited, logs, office
from gridloom.streaming import log_stream


def cells(spark, values):
    return spark.createDataFrame([("S", r, c, t, None) for (r, c), t in values.items()], "sheet string, row bigint, col int, text string, num double")


def grid_of(df):
    return {(r.row, r.col): r.text for r in df.collect()}


def test_grid(spark):
    assert grid_of(grid.dedup_rows(cells(spark, {(1, 1): "x", (2, 1): "X", (3, 1): "y"}), 1, 1, 3, 1)) == {(1, 1): "x", (3, 1): "y"}
    two = cells(spark, {(1, 1): "đầu", (2, 1): "sau"})
    assert grid_of(grid.insert_rows(two, 2)) == {(1, 1): "đầu", (3, 1): "sau"}
    assert grid_of(grid.delete_rows(grid.insert_rows(two, 2), 2)) == grid_of(two)
    merges = spark.createDataFrame([("S", 1, 1, 2, 3), ("S", 5, 5, 6, 6)], "sheet string, r1 int, c1 int, r2 int, c2 int")
    again = grid.merge_cells(merges, spark.createDataFrame([("S", 2, 3, 4, 4), ("S", 9, 9, 9, 9)], merges.schema))
    assert {tuple(r)[1:] for r in again.collect()} == {(5, 5, 6, 6), (2, 3, 4, 4)} and grid.unmerge(again, merges).count() == 0
    for text, place in (("A1", (1, 1)), ("B10", (10, 2)), ("Z100", (100, 26)), ("AA1", (1, 27)), ("ZZZ9", (9, 18278))):
        row, col = grid.parse_address(F.lit(text))
        got = spark.range(1).select(row.alias("r"), col.alias("c"), grid.address(F.lit(place[0]), F.lit(place[1])).alias("a")).first()
        assert (got.r, got.c) == place and got.a == text
    assert grid.extent(two.where("false")).first() == (1, 1)


def test_pages(spark):
    for expression, want in (("1,3,5", [1, 3, 5]), ("2-4", [2, 3, 4]), ("1, 3-4, 8", [1, 3, 4, 8]), ("8-", [8, 9, 10]), ("chẵn", [2, 4, 6, 8, 10]), ("odd", [1, 3, 5, 7, 9]), ("99", []), ("4-2", [2, 3, 4]), ("last", [10]), ("", [])):
        assert pages.parse_pages(expression, 10) == want
    numbers = spark.createDataFrame([(1, n) for n in (1, 2, 3, 7, 10, 11, 12, 12)], "doc_id int, page_no int")
    assert pages.describe_pages(numbers).first().pages == "1-3, 7, 10-12"
    doc = lambda *lines: spark.createDataFrame([(1, 1, "\n".join(lines))], "doc_id int, page_no int, text string")
    same = pages.compare_documents(doc("Dong mot", "Dong hai"), doc("Dong hai ", "", "Dong mot"))
    changed = pages.compare_documents(doc("Dong mot", "Dong hai", "Dong ba"), doc("Dong mot", "Dong 2", "Dong ba"))
    assert same.count() == 0 and tuple(changed.first()) == (1, 1, 1, 1)
    found = spark.range(1).select(pages.detect_columns(F.array(*(F.lit(float(x)) for x in (100, 10, 11, 60, 105)))).alias("s")).select("s", pages.column_of(F.col("s"), F.lit(99.5)).alias("c")).first()
    assert found.s == [10, 60, 100] and found.c == 3


def test_records(spark):
    store = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, name string, version int")
    changes = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], store.schema)
    assert {tuple(r) for r in records.upsert(store, changes, "id", "version").collect()} == {(1, "a", 1), (2, "d", 3), (3, "e", 1)}
    events = [("x", t, a) for t, a in enumerate(["enqueue", "start", "fail", "retry", "start", "shared"])] + [("y", 0, "enqueue"), ("y", 1, "missing"), ("z", 0, "start")]
    got = {r.id: (r.state, r.retries) for r in records.queue_states(spark.createDataFrame(events, "id string, at int, action string"), "id", "at", "action").collect()}
    assert got == {"x": ("UploadedShared", 1), "y": ("Failed", 0), "z": ("LocalOnly", 0)}
    captures = spark.createDataFrame([("alpha.png", "UploadedPrivate", 1), ("beta.png", "Failed", 2)], "display_name string, upload_state string, created_at int")
    assert [r.display_name for r in records.history(captures, "BETA", "Failed").collect()] == ["beta.png"]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src bigint, dst bigint")
    assert {r.node for r in records.reachable(edges, spark.createDataFrame([(1,)], "node bigint")).collect()} == {1, 2, 3}


def test_redaction(spark):
    for raw, want in [
        ("Authorization: Bearer abc.def.ghi", "Authorization: [REDACTED]"), ("access_token=secret-token&x=1", "access_token=[REDACTED]&x=1"), ("refresh_token: very-secret", "refresh_token: [REDACTED]"),
        ("code=oauth-code-123", "code=[REDACTED]"), ('inner {"access_token":"secret"}', 'inner {"access_token":"[REDACTED]"}'), ('{"Authorization":"Bearer json-secret"}', '{"Authorization":"[REDACTED]"}'),
        ("failed with Bearer standalone-secret", "failed with Bearer [REDACTED]"), ("key private_abcdef1234567890 in body", "key [REDACTED] in body"),
    ]:
        assert spark.range(1).select(activity.redact(F.lit(raw)).alias("x")).first().x == want


def test_retention_of_files(spark):
    files = spark.createDataFrame([("activity-20260801.ndjson",), ("activity-20260906.ndjson",), ("notes.txt",)], "name string")
    assert [r.name for r in activity.retained_files(files, F.lit("2026-10-05").cast("date")).collect()] == ["activity-20260906.ndjson"]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Item, with comma",100\n =A1 , "say ""hi"""\n,\n"x\ny",2\n')
    rows = delimited.read_rows(spark, str(tmp_path / "a.csv")).collect()
    assert rows[0][0] == "Item, with comma" and rows[-1][0] == "x\ny" and len(rows) == 3
    got = {(r.row, r.col): (r.text, r.num, r.formula) for r in delimited.read_cells(spark, str(tmp_path / "a.csv")).where("row <= 2").collect()}
    assert got[1, 1] == ("Item, with comma", None, None) and got[1, 2] == ("100", 100.0, None) and got[2, 1] == ("=A1", None, "=A1")
    (tmp_path / "b.csv").write_text("a;b;c\n1,5;2;3\n")
    assert delimited.sniff_separator(spark, str(tmp_path / "b.csv")) == ";"
    line = spark.createDataFrame([("a", "b,c", 'd"e')], "x string, y string, z string")
    assert delimited.as_lines(line).first().line == 'a,"b,c","d""e"'


def test_office_files(spark, tmp_path):
    content = office.workbook_bytes({"Doanh thu": {(1, 1): "product", (2, 1): "pen & ink", (2, 2): 50000000, (3, 2): "=SUM(B2:B2)"}, "Chi phí": {(1, 27): 1.5}})
    (tmp_path / "w.xlsx").write_bytes(content)
    got = {(r.sheet, r.row, r.col): (r.text, r.num, r.formula) for r in office.read_workbooks(spark, str(tmp_path / "w.xlsx")).collect()}
    assert got["Doanh thu", 2, 1] == ("pen & ink", None, None) and got["Doanh thu", 2, 2][1] == 5e7 and got["Doanh thu", 3, 2][2] == "=SUM(B2:B2)" and got["Chi phí", 1, 27][1] == 1.5
    again = office.workbook_files(spark.createDataFrame([("b", "S", 1, 1, "x", None), ("b", "S", 1, 2, "2", 2.0)], "workbook string, sheet string, row int, col int, text string, num double")).first()
    assert [c[3] for c in office.workbook_cells(bytes(again.content))] == ["x", "2.0"]
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", word)
    blocks = office.read_documents(spark, str(tmp_path / "d.docx")).orderBy("block").collect()
    assert [(b.kind, b.text) for b in blocks] == [("heading1", "Title"), ("paragraph", "ab"), ("table", "")] and blocks[2].cells == [["1", ""]]
    assert office.rtf_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}\b Bold\b0  text\par n\u226?t}").strip() == "Bold text\nnât"
    blocks = spark.createDataFrame([("x", 0, "heading2", "Tiêu đề {a}", None), ("x", 1, "table", "", [["1", "<2>"]]), ("x", 2, "paragraph", "chữ & số", None)], "path string, block bigint, kind string, text string, cells array<array<string>>")
    made = bytes(office.document_files(blocks).first().content)
    assert [tuple(b)[1:] for b in office.document_blocks(made)] == [("heading2", "Tiêu đề {a}", None), ("table", "", [["1", "<2>"]]), ("paragraph", "chữ & số", None)]
    rtf = bytes(office.document_files(blocks.where("kind = 'paragraph'"), "rtf").first().content)
    assert rtf.startswith(b"{\\rtf1") and office.rtf_text(rtf).strip() == "chữ & số"
    bundle = io.BytesIO()
    with zipfile.ZipFile(bundle, "w") as z:
        z.writestr("manifest.json", "{}")
        z.writestr("docs/1.json", json.dumps({"t": "é"}))
        z.writestr("other/x.json", "{}")
    assert [p[1] for p in office.bundle_parts(bundle.getvalue())] == ["document", "manifest"]
    with pytest.raises(ValueError, match="no reader"):
        office.reader_for("a.exe")


def test_workbooks_keep_merges_and_formats(spark, tmp_path):
    cells = [("b", "S", 1, 1, "title", None, None), ("b", "S", 2, 1, "46262", 46262.0, "dd/mm/yyyy"), ("b", "S", 2, 2, "3", 3.0, '0.0" days"'), ("b", "T", 1, 28, "x", None, None)]
    frame = spark.createDataFrame(cells, "workbook string, sheet string, row int, col int, text string, num double, format string")
    merges = spark.createDataFrame([("b", "S", 1, 1, 1, 3), ("b", "T", 1, 28, 4, 29)], "workbook string, sheet string, r1 int, c1 int, r2 int, c2 int")
    content = bytes(office.workbook_files(frame, merges).first().content)
    assert set(office.workbook_merges(content)) == {("S", 1, 1, 1, 3), ("T", 1, 28, 4, 29)}
    (tmp_path / "b.xlsx").write_bytes(content)
    styles = {(r.sheet, r.row, r.col): (r.format, r.is_date) for r in office.read_styles(spark, str(tmp_path / "b.xlsx")).collect()}
    assert styles == {("S", 2, 1): ("dd/mm/yyyy", True), ("S", 2, 2): ('0.0" days"', False)}
    assert office.read_merges(spark, str(tmp_path / "b.xlsx")).count() == 2 and office.read_workbooks(spark, str(tmp_path / "b.xlsx")).count() == 4
    table = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts><font/><font><b/><color rgb="FF00AA11"/></font></fonts><cellXfs><xf/><xf numFmtId="14" fontId="1"/></cellXfs></styleSheet>'
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" s="1"><v>5</v></c><c r="B1" s="0"/></row></sheetData><mergeCells><mergeCell ref="bad"/></mergeCells></worksheet>'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="A" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/styles.xml", table)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert list(office.workbook_styles(made.getvalue())) == [("A", 1, 1, "mm-dd-yy", True, True, False, "#00AA11")] and list(office.workbook_merges(made.getvalue())) == []


def test_workbooks_keep_looks_and_what_formulas_gave(spark, tmp_path):
    rows = [("b", "S", 1, 1, "total", None, None, None, True, False, "#00AA11"), ("b", "S", 1, 2, "5", 5.0, "=SUM(B2:B3)", "0.00", False, True, None), ("b", "S", 2, 2, "yes <no>", None, '=IF(1>0,"yes <no>")', None, None, None, None), ("b", "S", 3, 2, "3", 3.0, None, None, True, True, "#FF0000")]
    frame = spark.createDataFrame(rows, "workbook string, sheet string, row int, col int, text string, num double, formula string, format string, bold boolean, italic boolean, color string")
    (tmp_path / "b.xlsx").write_bytes(bytes(office.workbook_files(frame).first().content))
    got = {(r.row, r.col): (r.text, r.num, r.formula) for r in office.read_workbooks(spark, str(tmp_path / "b.xlsx")).collect()}
    assert got == {(1, 1): ("total", None, None), (1, 2): ("5.0", 5.0, "=SUM(B2:B3)"), (2, 2): ("yes <no>", None, '=IF(1>0,"yes <no>")'), (3, 2): ("3.0", 3.0, None)}
    looks = {(r.row, r.col): (r.format, r.bold, r.italic, r.color) for r in office.read_styles(spark, str(tmp_path / "b.xlsx")).collect()}
    assert looks == {(1, 1): ("General", True, False, "#00AA11"), (1, 2): ("0.00", False, True, None), (3, 2): ("General", True, True, "#FF0000")}


def test_bundles_texts_and_sheets_round_trip(spark, tmp_path):
    parts = spark.createDataFrame([("p", "sheet", "s1", '{"a": 1}'), ("p", "document", "d2", '{"t": "é"}'), ("p", "document", "d1", "[]")], "bundle string, kind string, id string, body string")
    (tmp_path / "p.zip").write_bytes(bytes(office.bundle_files(parts).first().content))
    got = {r.part: (r.kind, json.loads(r.body)) for r in office.read_bundles(spark, str(tmp_path / "p.zip")).collect()}
    assert got.pop("manifest.json") == ("manifest", {"ManifestVersion": "1.0", "Name": "p", "DocCount": 2, "SheetCount": 1})
    assert got == {"docs/doc_0_d1.json": ("document", []), "docs/doc_1_d2.json": ("document", {"t": "é"}), "sheets/sheet_0_s1.json": ("sheet", {"a": 1})}
    blocks = spark.createDataFrame([("x", 0, "paragraph", "one", None), ("x", 1, "pagebreak", "", None), ("x", 2, "paragraph", "two", None)], "path string, block bigint, kind string, text string, cells array<array<string>>")
    assert bytes(office.document_files(blocks, "txt").first().content).decode() == "one\n\n--- PAGE BREAK ---\n\ntwo"
    sheet = cells(spark, {(1, 2): "é", (4, 1): 'a,"b'})
    delimited.write_sheet(sheet, str(tmp_path / "out.csv"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out.csv").glob("part-*")))
    assert text == b'\xef\xbb\xbf' + ',é\n,\n,\n"a,""b",\n'.encode()


def test_documents_keep_runs(spark, tmp_path):
    blocks = spark.createDataFrame([("x", 0, "heading1", "Title", None), ("x", 1, "paragraph", "ab", None), ("x", 2, "table", "", [["1"]])], "path string, block bigint, kind string, text string, cells array<array<string>>")
    runs = [("x", 1, 0, "a & ", True, False, False, "Arial", 14, "#FF0000"), ("x", 1, 1, "b", False, True, True, None, None, None)]
    content = bytes(office.document_files(blocks, runs=spark.createDataFrame(runs, office.RUNS)).first().content)
    assert [b[2] for b in office.document_blocks(content)] == ["Title", "a & b", ""]
    (tmp_path / "d.docx").write_bytes(content)
    got = [tuple(r)[1:] for r in office.read_runs(spark, str(tmp_path / "d.docx")).orderBy("block", "run").collect()]
    assert got == [(0, 0, "Title", False, False, False, None, None, None), *(r[1:] for r in runs)]


def _log(spark, rows):
    return spark.createDataFrame(rows, "id string, occurred_at timestamp, tool_id string, success boolean, action string")


def test_log_files_and_streams(spark, tmp_path):
    day = datetime.datetime(2026, 10, 5, 8)
    rows = [(str(k), day + datetime.timedelta(minutes=k), f"t{k % 2}", k % 3 > 0, a) for k, a in enumerate(["enqueue", "start", "shared", "enqueue", "start", "fail"])]
    _log(spark, rows + rows[:2]).coalesce(1).write.json(str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text("{not json\n")
    assert logs.read_log(spark, str(tmp_path / "log")).count() == 8 and logs.pending_count(spark, str(tmp_path / "log" / "bad.json")) == 1
    stream = log_stream.read_log_stream(spark, str(tmp_path / "log")).where("id is not null")
    results: dict[str, list] = {"once": [], "queue": []}
    log_stream.each_batch(log_stream.once(stream), lambda b, n: results["once"].extend(b.collect()), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r.id for r in results["once"]) == [str(k) for k in range(6)]
    states = log_stream.queue_stream(stream.withColumn("id", F.col("tool_id")), "id", "occurred_at", "action")
    query = states.writeStream.outputMode("update").foreachBatch(lambda b, n: results["queue"].extend(b.collect())).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.id for r in results["queue"]} == {"t0", "t1"}
    batch = log_stream.error_rates(logs.read_log(spark, str(tmp_path / "log")).where("id is not null"))
    assert sum(r.total for r in batch.collect()) == 8


def test_queries_and_sql_name_each_other():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_fragments_keep_the_first_height_of_a_line(spark):
    from gridloom.operators import fragments as R

    rows = [(1, 1, t, x, y, 20.0, 10.0) for t, x, y in (("b", 40.0, 96.0), ("a", 10.0, 100.0), ("c", 61.0, 95.0), ("d", 10.0, 94.0), ("", 10.0, 50.0))]
    frame = spark.createDataFrame(rows, "doc_id int, page_no int, text string, x double, y double, width double, size double")
    assert [r.text for r in R.text_lines(frame).orderBy("line_no").collect()] == ["a" + " " + "b" + "c", "d"]
    assert [r.cells for r in R.tables(frame).orderBy("row_no").collect()] == [["a", "b", "c"], ["d", "", ""]]
    runs = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", True), (1, 3, "c", None), (1, 4, "d", None), (1, 5, "e", True)], "block_id int, run_no int, text string, bold boolean")
    assert [r.text for r in R.merge_runs(runs, ["bold"]).orderBy("run_no").collect()] == ["ab", "cd", "e"]


def test_layers_keep_an_undo_stack(spark):
    """Against a plain loop over random commands, with a short history."""
    rng = random.Random(3)
    actions = ["add", "add", "move", "delete", "undo", "undo", "redo", "clear"]
    log = [(d, k, rng.choices(actions, [5, 5, 6, 2, 5, 4, 5, 1])[0], rng.choice("abcd"), float(rng.randrange(9)), float(rng.randrange(9))) for d in range(4) for k in range(60)]
    for limit in (3, 100):
        want = {}
        for d in range(4):
            applied, redo, depth = [], [], 0
            for e in (e for e in log if e[0] == d):
                if e[2] == "undo":
                    if depth:
                        redo.append(applied.pop())
                        depth -= 1
                elif e[2] == "redo":
                    if redo:
                        applied.append(redo.pop())
                        depth += 1
                else:
                    applied.append(e)
                    redo, depth = [], min(depth + 1, limit)
            layers = []
            for _, _, action, layer, dx, dy in applied:
                if action == "add":
                    layers.append((layer, dx, dy))
                elif action == "move":
                    layers = [(n, x + dx, y + dy) if n == layer else (n, x, y) for n, x, y in layers]
                else:
                    layers = [a for a in layers if action == "delete" and a[0] != layer]
            want[d] = layers
        frame = spark.createDataFrame(log, "doc_id int, at int, action string, layer string, dx double, dy double").repartition(3)
        got = {r.doc_id: [tuple(a) for a in r.layers] for r in records.layers_after(frame, limit=limit).collect()}
        assert got == want


def test_queue_states_of_hot_keys(spark):
    """Keys with more events than a row holds are cut into runs; some, a null one among them, just reach the bound."""
    rng = random.Random(7)
    actions = ["enqueue", "start", "fail", "retry", "auth", "shared", "private", "missing", "cancel"]
    rows = [(key, t // 2, rng.choice(actions)) for key, n in (("hot", 400), (None, 90), ("even", 50), ("few", 7)) for t in range(n)]
    frame = spark.createDataFrame(rows, "id string, at int, action string").repartition(3)
    of = lambda at_once: {r.id: (r.state, r.retries) for r in records.queue_states(frame, "id", "at", "action", at_once).collect()}
    assert of(50) == of(3) == of(10_000) and len(of(50)) == 4


def test_queue_states_are_the_same_in_a_batch_and_on_a_stream(spark, tmp_path):
    events = ["enqueue", "start", "fail", "retry", "start", "auth", "shared", "retry", "start", "private", "missing", "cancel"]
    day = datetime.datetime(2026, 10, 5, 8)
    rows = [(str(k), day + datetime.timedelta(minutes=k), f"t{k % 2}", True, events[k // 2]) for k in range(2 * len(events))]
    _log(spark, rows).coalesce(1).write.json(str(tmp_path / "log"))
    want = {r.tool_id: (r.state, r.retries) for r in records.queue_states(_log(spark, rows), "tool_id", "occurred_at", "action").collect()}
    assert want["t0"] == ("UploadedPrivate", 2)
    got = {}
    stream = log_stream.queue_stream(log_stream.read_log_stream(spark, str(tmp_path / "log")).withColumn("id", F.col("tool_id")), "id", "occurred_at", "action")
    take = lambda b, n: got.update({r.id: (r.state, r.retries) for r in b.collect()})
    stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert got == want


def test_error_rates_and_a_sink_on_a_stream(spark, tmp_path):
    day = datetime.datetime(2026, 10, 5, 8)
    rows = [(str(k % 20), day + datetime.timedelta(minutes=k % 20), f"t{k % 2}", k % 3 > 0, "run") for k in range(30)]
    _log(spark, rows).coalesce(2).write.json(str(tmp_path / "log"))
    stream = log_stream.read_log_stream(spark, str(tmp_path / "log"))
    seen = []
    rates = log_stream.error_rates(stream)
    keep = lambda b, n: seen.extend(b.collect())
    rates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert sum(r.total for r in seen) == 30 and sum(r.failures for r in seen) == 10 and {r.window_start.minute for r in seen} == {0, 10}
    query = log_stream.write_once(stream, str(tmp_path / "table"), str(tmp_path / "c2"), period="1 second")
    query.processAllAvailable()
    query.stop()
    assert sorted(int(r.id) for r in spark.read.parquet(str(tmp_path / "table")).collect()) == list(range(20))


def test_newest_days_stores_and_their_backups(spark, tmp_path):
    days = [datetime.datetime(2026, 10, k, 8) for k in range(1, 8)]
    log = _log(spark, [(str(k), d, "t", True, "run") for k, d in enumerate(days)])
    logs.write_log(log, str(tmp_path / "log"))
    assert sorted(r.id for r in logs.read_newest(spark, str(tmp_path / "log"), 5).collect()) == ["2", "3", "4", "5", "6"]
    path, schema = str(tmp_path / "store.json"), T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    assert logs.read_store(spark, path, schema).count() == 0
    for name in ("old", "new"):
        logs.write_store(spark.createDataFrame([(1, name)], schema), path)
    assert [r.name for r in logs.read_store(spark, path, schema).collect()] == ["new"]
    (tmp_path / "store.json" / "part-damaged.json").write_text('[{"id": 1, ')
    assert [r.name for r in logs.read_store(spark, path, schema).collect()] == ["old"]
    (tmp_path / "store.json").rename(tmp_path / "gone")  # a writer died between its two renames
    assert [r.name for r in logs.read_store(spark, path, schema).collect()] == ["old"]


def test_measured_work_is_logged(spark):
    rows = []
    assert activity.measured(lambda: b"abc", rows.append, "pdf-tool", "run", "merge", "A.PDF", 9) == b"abc"
    with pytest.raises(ValueError, match="bad"):
        activity.measured(lambda: (_ for _ in ()).throw(ValueError("bad")), rows.append, "pdf-tool", "run")
    good, bad = activity.log_rows(spark, rows).collect()
    assert (good.level, good.success, good.file_ext, good.result_size_bytes) == ("info", True, ".pdf", 3)
    assert (bad.level, bad.success, bad.message, bad.error_type) == ("error", False, "bad", "ValueError") and "ValueError" in bad.error_detail


def test_cells_of_delimited_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text('a|b|c\n\n 1,5 |"x|""y"|=A1\n')
    (tmp_path / "two.csv").write_text("".join(f"{k}|{k * 2}\n" for k in range(1, 5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        cells = delimited.read_cells(spark, str(tmp_path / "*.csv"), "|")
        one = [(r.row, r.col, r.text, r.num, r.formula) for r in cells.where("sheet = 'one'").orderBy("row", "col").collect()]
        assert one == [(1, 1, "a", None, None), (1, 2, "b", None, None), (1, 3, "c", None, None), (3, 1, "1,5", 15.0, None), (3, 2, 'x|"y', None, None), (3, 3, "=A1", None, "=A1")]
        two = cells.where("sheet = 'two'")
        assert two.count() == 2 * 4999 and two.where("num <> row * col").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sheets():
    assert grid.add_sheet(["Sheet1", "sheet3"]) == ["Sheet1", "sheet3", "Sheet4"] and grid.add_sheet(["a"], "b") == ["a", "b"]


def test_set_values_and_letters(spark):
    cells = spark.createDataFrame([("s", 1, 1, "old", None)], "sheet string, row bigint, col int, text string, num double")
    values = spark.createDataFrame([("s", 1, 1, "z", 1), ("s", 1, 1, "7", 2), ("s", 2, 1, "", 3)], "sheet string, row bigint, col int, text string, at int")
    assert [(r.row, r.text, r.num) for r in grid.set_values(cells, values, "at").collect()] == [(1, "7", 7.0)]
    assert [r.text for r in grid.set_values(cells, values).collect()] == ["z"]
    got = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,), (18278,), (18279,), (2**31 - 1,)], "n bigint").select(grid.col_letters(F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA", "FXSHRXW"]


def test_letters_of_every_number(spark):
    numbers = [0, -5, 2**31, 8_353_082_582, 8_353_082_583, 9_080_998_991, 2**53 + 1, 2**63 - 1]
    frame = spark.createDataFrame([(n,) for n in numbers], "n bigint").withColumn("x", grid.col_letters(F.col("n")))
    got = {r.n: (r.x, r.back) for r in frame.withColumn("back", grid.col_number(F.col("x"))).collect()}
    for n in numbers:
        left, want = n, ""
        while left > 0:
            left, k = divmod(left - 1, 26)
            want = chr(65 + k) + want
        assert got[n] == (want, max(n, 0))


def test_numbers_of_a_hot_key(spark):
    from gridloom.operators.rounds import numbered

    frame = spark.createDataFrame([("hot" if k % 10 else None, k * 37 % 5003) for k in range(5003)], "name string, at int").repartition(7)
    rows = numbered(frame, ["name"], ["at"], "n").collect()
    for name in ("hot", None):
        mine = sorted((r.at, r.n) for r in rows if r.name == name)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
