"""Office files as DataFrames: workbooks, text documents, RTF, bundles. Each file is read by one task with the
standard library's zip and XML readers; the files are distributed as Spark's binaryFile source splits them.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gridloom.sources import delimited

CELLS = "path string, sheet string, row bigint, col int, text string, num double, formula string"
BLOCKS = "path string, block bigint, kind string, text string, cells array<array<string>>"
PARTS = "path string, part string, kind string, body string"
MERGES = "path string, sheet string, r1 int, c1 int, r2 int, c2 int"
STYLES = "path string, sheet string, row bigint, col int, format string, is_date boolean, bold boolean, italic boolean, color string"
RUNS = "path string, block bigint, run int, text string, bold boolean, italic boolean, underline boolean, font string, size int, color string"
# fixed values: number formats that workbooks name by number only
_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@",
}
#: Number of the first format that a file defines itself.
_OWN_FORMATS = 164
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _files(spark: SparkSession, path: str, schema: str, rows: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    columns = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(file, *row) for row in rows(content)], columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, ElementTree.Element]]:
    """Title and content of each sheet, in order."""
    titles = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
    for number, title in enumerate(titles, 1):
        if f"xl/worksheets/sheet{number}.xml" not in book.namelist():
            break
        yield title, ElementTree.fromstring(book.read(f"xl/worksheets/sheet{number}.xml"))


def _place(reference: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", reference).groups()
    return int(row), _column(letters)


def workbook_merges(content: bytes) -> Iterator[tuple]:
    """(sheet, r1, c1, r2, c2) of each merged range."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for title, sheet in _sheets(book):
            for merge in sheet.iter(f"{_MAIN}mergeCell"):
                if found := re.fullmatch(r"([A-Z]+\d+):([A-Z]+\d+)", merge.get("ref") or ""):
                    yield title, *_place(found[1]), *_place(found[2])


def _is_date(code: str) -> bool:
    """Does a number format show a date or a time? Texts in quotes, brackets and behind a backslash don't count."""
    return bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I)) and code != "General"


def workbook_styles(content: bytes) -> Iterator[tuple]:
    """(sheet, row, col, format, is_date, bold, italic, color) of each cell that has a style."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        if "xl/styles.xml" not in book.namelist():
            return
        table = ElementTree.fromstring(book.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in table.iter(f"{_MAIN}numFmt")}
        fonts = list(table.find(f"{_MAIN}fonts") if table.find(f"{_MAIN}fonts") is not None else [])
        formats = table.find(f"{_MAIN}cellXfs")
        styles = []
        for xf in formats if formats is not None else []:
            number, font = int(xf.get("numFmtId") or 0), int(xf.get("fontId") or 0)
            face = fonts[font] if font < len(fonts) else ElementTree.Element("font")
            code, color = own.get(number) or _FORMATS.get(number, "General"), face.find(f"{_MAIN}color")
            shade = color.get("rgb") if color is not None else None
            styles.append((code, _is_date(code), face.find(f"{_MAIN}b") is not None, face.find(f"{_MAIN}i") is not None, "#" + shade[-6:] if shade else None))
        for title, sheet in _sheets(book):
            for cell in sheet.iter(f"{_MAIN}c"):
                style = int(cell.get("s") or 0)
                if 0 < style < len(styles):
                    yield title, *_place(cell.get("r")), *styles[style]


def workbook_cells(content: bytes) -> Iterator[tuple]:
    """(sheet, row, col, text, num, formula) of each cell with content, sheet by sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        for title, sheet in _sheets(book):
            for cell in sheet.iter(f"{_MAIN}c"):
                row, col = _place(cell.get("r"))
                formula, value = cell.findtext(f"{_MAIN}f"), cell.findtext(f"{_MAIN}v")
                kind = cell.get("t")
                if kind == "s":
                    text = shared[int(value)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                else:
                    text = value or ""
                if text or formula:
                    num = None if kind in ("s", "inlineStr", "str") else _number(text)
                    yield title, row, col, text, num, f"={formula}" if formula else None


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, CELLS, workbook_cells)


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, MERGES, workbook_merges)


def read_styles(spark: SparkSession, path: str) -> DataFrame:
    """Styles of cells; where is_date is true, the cell's num is a serial date (`coerce.serial_to_date`)."""
    return _files(spark, path, STYLES, workbook_styles)


def document_blocks(content: bytes) -> Iterator[tuple]:
    """(block, kind, text, cells): paragraphs and headings with their text, tables with their cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as doc:
        body = ElementTree.fromstring(doc.read("word/document.xml")).find(f"{_WORD}body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    for number, element in enumerate(e for e in body if e.tag in (f"{_WORD}p", f"{_WORD}tbl")):
        if element.tag == f"{_WORD}tbl":
            yield number, "table", "", [[text_of(c) for c in row.iter(f"{_WORD}tc")] for row in element.iter(f"{_WORD}tr")]
        else:
            style = element.find(f"{_WORD}pPr/{_WORD}pStyle")
            name = style.get(f"{_WORD}val") if style is not None else ""
            yield number, f"heading{name[-1]}" if re.fullmatch("Heading[1-3]", name) else "paragraph", text_of(element), None


def document_runs(content: bytes) -> Iterator[tuple]:
    """(block, run, text, bold, italic, underline, font, size in points, color) of each run of text in a paragraph or heading."""
    with zipfile.ZipFile(io.BytesIO(content)) as doc:
        body = ElementTree.fromstring(doc.read("word/document.xml")).find(f"{_WORD}body")
    for number, element in enumerate(e for e in body if e.tag in (f"{_WORD}p", f"{_WORD}tbl")):
        for k, run in enumerate(element.findall(f"{_WORD}r") if element.tag == f"{_WORD}p" else []):
            text, look = run.findtext(f"{_WORD}t"), run.find(f"{_WORD}rPr")
            look = ElementTree.Element("rPr") if look is None else look
            value = lambda tag, name="val": None if (e := look.find(f"{_WORD}{tag}")) is None else e.get(f"{_WORD}{name}")  # noqa: B023, E731
            halves, color = value("sz") or "", value("color")
            if text:
                flags = (look.find(f"{_WORD}{tag}") is not None for tag in "biu")
                yield number, k, text, *flags, value("rFonts", "ascii") or None, int(halves) // 2 if halves.isdigit() and halves != "0" else None, f"#{color}" if color and color != "auto" else None


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, BLOCKS, document_blocks)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, RUNS, document_runs)


def rtf_text(content: bytes) -> str:
    """Text only: control words and groups of tables are dropped, \\u and \\' escapes decoded."""
    text = content.decode("latin-1")
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\par\b ?", "\n", text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text)


def read_rtf(spark: SparkSession, path: str) -> DataFrame:
    """A paragraph per row, blank ones dropped."""
    return _files(spark, path, BLOCKS, lambda c: ((k, "paragraph", line, None) for k, line in enumerate(x.strip() for x in rtf_text(c).split("\n") if x.strip())))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A line per row."""
    return _files(spark, path, BLOCKS, lambda c: ((k, "paragraph", line, None) for k, line in enumerate(c.decode("utf-8-sig").splitlines())))


def bundle_parts(content: bytes) -> Iterator[tuple]:
    """(part, kind, body): the JSON parts of a bundle; kind is manifest, document or sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as bundle:
        for name in sorted(bundle.namelist()):
            kind = "manifest" if name == "manifest.json" else {"docs": "document", "sheets": "sheet"}.get(name.split("/")[0])
            if kind:
                yield name, kind, json.dumps(json.loads(bundle.read(name)), ensure_ascii=False)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, PARTS, bundle_parts)


#: How a text file shows a page break: a mark between blank lines.
PAGE_BREAK_LINES = "\n--- PAGE BREAK ---\n"
#: Which reader takes which extension.
READERS = {".csv": delimited.read_rows, ".xlsx": read_workbooks, ".docx": read_documents, ".rtf": read_rtf, ".txt": read_text, ".zip": read_bundles}


def reader_for(path: str) -> Callable[[SparkSession, str], DataFrame]:
    extension = "." + path.rsplit(".", 1)[-1].lower()
    if extension not in READERS:
        raise ValueError(f"no reader for {extension}")
    return READERS[extension]


#: A cell's look: number format, bold, italic, colour (as #RRGGBB).
Look = tuple[str | None, bool, bool, str | None]
PLAIN: Look = (None, False, False, None)


def _style_table(looks: list[Look]) -> str:
    """The style sheet of a workbook: each look is a cell format after the plain one, with a font of its own where it has one."""
    from xml.sax.saxutils import escape

    fonts = sorted({look[1:] for look in looks} | {PLAIN[1:]}, key=lambda f: (f != PLAIN[1:], f[0], f[1], f[2] or ""))
    codes = sorted({look[0] for look in looks if look[0]})
    own = "".join(f'<numFmt numFmtId="{_OWN_FORMATS + k}" formatCode="{escape(code, {chr(34): "&quot;"})}"/>' for k, code in enumerate(codes))
    faces = "".join(f"<font>{'<b/>' * bold}{'<i/>' * italic}{f'<color rgb={chr(34)}FF{color[-6:].upper()}{chr(34)}/>' if color else ''}</font>" for bold, italic, color in fonts)
    number = lambda code: _OWN_FORMATS + codes.index(code) if code else 0
    formats = "".join(f'<xf numFmtId="{number(look[0])}" fontId="{fonts.index(look[1:])}"{" applyNumberFormat=" + chr(34) + "1" + chr(34) if look[0] else ""}/>' for look in [PLAIN, *looks])
    return f'<styleSheet xmlns="{_MAIN[1:-1]}">{f"<numFmts>{own}</numFmts>" if own else ""}<fonts>{faces}</fonts><cellXfs>{formats}</cellXfs></styleSheet>'


def workbook_bytes(
    sheets: dict[str, dict[tuple[int, int], object]], merges: dict[str, list[tuple[int, int, int, int]]] | None = None, looks: dict[str, dict[tuple[int, int], Look]] | None = None
) -> bytes:
    """A workbook of sheets of (row, col) -> value: a number, a text, a formula (a text that starts with =), or a formula and what it gave (a pair). With merged ranges and looks of cells."""
    from xml.sax.saxutils import escape

    def letters(n: int) -> str:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    merges, looks = merges or {}, looks or {}
    styles = sorted({look for of in looks.values() for look in of.values() if look != PLAIN}, key=str)

    def cell(row: int, col: int, value: object, look: Look) -> str:
        at = f'<c r="{letters(col)}{row}"' + (f' s="{styles.index(look) + 1}"' if look != PLAIN else "")
        formula, value = value if isinstance(value, tuple) else (value, None) if isinstance(value, str) and value.startswith("=") else (None, value)
        number = isinstance(value, int | float)
        if formula:
            shown = "" if value is None else f"<v>{value if number else escape(str(value))}</v>"
            return f"{at}{'' if number or value is None else ' t=' + chr(34) + 'str' + chr(34)}><f>{escape(formula[1:])}</f>{shown}</c>"
        return f"{at}><v>{value}</v></c>" if number else f'{at} t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        entries = "".join(f'<sheet name="{escape(name)}" sheetId="{k}"/>' for k, name in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}"><sheets>{entries}</sheets></workbook>')
        if styles:
            book.writestr("xl/styles.xml", _style_table(styles))
        for k, (name, cells) in enumerate(sheets.items(), 1):
            rows: dict[int, list[str]] = {}
            for (row, col), value in sorted(cells.items(), key=lambda x: x[0]):
                rows.setdefault(row, []).append(cell(row, col, value, looks.get(name, {}).get((row, col), PLAIN)))
            body = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows.items())
            ranges = "".join(f'<mergeCell ref="{letters(c1)}{r1}:{letters(c2)}{r2}"/>' for r1, c1, r2, c2 in merges.get(name, []))
            merged = f"<mergeCells>{ranges}</mergeCells>" if ranges else ""
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData>{merged}</worksheet>')
    return out.getvalue()


def workbook_files(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """A workbook per name: cells to bytes (workbook, content).

    cells: workbook, sheet, row, col, text, num and, if there, formula (then text and num are what it gave), format, bold, italic, color.
    merges: workbook, sheet, r1, c1, r2, c2. A workbook is one file, so one workbook's cells meet in one task.
    """

    def build(key: tuple, frame: pd.DataFrame, ranges: pd.DataFrame | None = None) -> pd.DataFrame:
        sheets: dict[str, dict] = {}
        looks: dict[str, dict] = {}
        merged: dict[str, list] = {}
        word = lambda r, name: x if isinstance(x := getattr(r, name, None), str) else None
        flag = lambda r, name: not pd.isna(x := getattr(r, name, None)) and bool(x)
        for r in frame.itertuples():
            value, formula = r.text if pd.isna(r.num) else float(r.num), word(r, "formula")
            sheets.setdefault(r.sheet, {})[int(r.row), int(r.col)] = (formula, value) if formula else value
            looks.setdefault(r.sheet, {})[int(r.row), int(r.col)] = (word(r, "format"), flag(r, "bold"), flag(r, "italic"), word(r, "color"))
        for r in ranges.itertuples() if ranges is not None else ():
            merged.setdefault(r.sheet, []).append((int(r.r1), int(r.c1), int(r.r2), int(r.c2)))
        return pd.DataFrame({"workbook": [key[0]], "content": [workbook_bytes(sheets, merged, looks)]})

    out = "workbook string, content binary"
    if merges is None:
        return cells.groupBy("workbook").applyInPandas(lambda key, frame: build(key, frame), out)
    return cells.groupBy("workbook").cogroup(merges.groupBy("workbook")).applyInPandas(lambda key, a, b: build(key, a, b), out)


def bundle_files(parts: DataFrame) -> DataFrame:
    """A bundle per name: parts (bundle, kind, id, body) to bytes (bundle, content). kind is document or sheet, body JSON; the manifest counts them. A bundle is one file, so its parts meet in one task."""

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values("id"), io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as bundle:
            of = {kind: frame[frame["kind"] == kind] for kind in ("document", "sheet")}
            manifest = {"ManifestVersion": "1.0", "Name": key[0], "DocCount": len(of["document"]), "SheetCount": len(of["sheet"])}
            bundle.writestr("manifest.json", json.dumps(manifest, indent=2, ensure_ascii=False))
            for kind, place in (("document", "docs/doc"), ("sheet", "sheets/sheet")):
                for k, (name, body) in enumerate(zip(of[kind]["id"], of[kind]["body"], strict=True)):
                    bundle.writestr(f"{place}_{k}_{name}.json", body)
        return pd.DataFrame({"bundle": [key[0]], "content": [out.getvalue()]})

    return parts.groupBy("bundle").applyInPandas(build, "bundle string, content binary")


def document_bytes(blocks: list[tuple[str, str, list[list[str]] | None]], runs: dict[int, list[dict]] | None = None) -> bytes:
    """A text document of (kind, text, cells): paragraphs, heading1 to heading3 and tables.

    runs: the runs (fields of RUNS) of blocks, by their place, that have any; they stand for the block's text.
    """
    from xml.sax.saxutils import escape

    def look(run: dict) -> str:
        flags = "".join(f"<w:{tag}{value}/>" for tag, name, value in (("b", "bold", ""), ("i", "italic", ""), ("u", "underline", ' w:val="single"')) if run.get(name))
        font = f'<w:rFonts w:ascii="{escape(run["font"])}"/>' if run.get("font") else ""
        color = f'<w:color w:val="{run["color"].lstrip("#")}"/>' if run.get("color") else ""
        size = f'<w:sz w:val="{int(run["size"]) * 2}"/>' if run.get("size") else ""
        return f"<w:rPr>{font}{flags}{color}{size}</w:rPr>"

    def paragraph(text: str, style: str = "", of: list[dict] | None = None) -> str:
        named = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        parts = "".join(f'<w:r>{look(r)}<w:t xml:space="preserve">{escape(r["text"])}</w:t></w:r>' for r in of or [{"text": text}])
        return f"<w:p>{named}{parts}</w:p>"

    body = ""
    for place, (kind, text, cells) in enumerate(blocks):
        if kind == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in cells or [])
            body += f"<w:tbl>{rows}</w:tbl>"
        else:
            body += paragraph(text, kind.capitalize() if kind.startswith("heading") else "", (runs or {}).get(place))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as doc:
        doc.writestr("word/document.xml", f'<w:document xmlns:w="{_WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def rtf_bytes(paragraphs: list[str]) -> bytes:
    """Paragraphs of text; characters beyond ASCII are escaped as UTF-16 units."""

    def escaped(text: str) -> str:
        out = ""
        for c in text:
            if c in "\\{}":
                out += "\\" + c
            elif ord(c) < 128:
                out += c
            else:
                units = c.encode("utf-16-le")
                out += "".join(f"\\u{int.from_bytes(units[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units), 2))
        return out

    return ("{\\rtf1\\ansi " + "\\par ".join(map(escaped, paragraphs)) + "}").encode("ascii")


def document_files(blocks: DataFrame, kind: str = "docx", runs: DataFrame | None = None) -> DataFrame:
    """A file per path: blocks (path, block, kind, text, cells) to bytes (path, content); kind is docx, rtf or txt. A docx may have runs (RUNS); a txt marks blocks of kind pagebreak."""

    def build(key: tuple, frame: pd.DataFrame, parts: pd.DataFrame | None = None) -> pd.DataFrame:
        frame = frame.sort_values("block")
        texts = [t or "" for t in frame["text"]]
        if kind == "docx":
            tables = [None if c is None else [list(row) for row in c] for c in frame["cells"]]
            places = {block: k for k, block in enumerate(frame["block"])}
            looks: dict[int, list[dict]] = {}
            for run in parts.sort_values(["block", "run"]).astype(object).to_dict("records") if parts is not None else ():
                looks.setdefault(places[run["block"]], []).append({name: None if pd.isna(value) else value for name, value in run.items()})
            content = document_bytes(list(zip(frame["kind"], texts, tables, strict=True)), looks)
        else:
            lines = [PAGE_BREAK_LINES if k == "pagebreak" else t for k, t in zip(frame["kind"], texts, strict=True)]
            content = rtf_bytes(texts) if kind == "rtf" else "\n".join(lines).encode()
        return pd.DataFrame({"path": [key[0]], "content": [content]})

    out = "path string, content binary"
    if runs is None:
        return blocks.groupBy("path").applyInPandas(lambda key, frame: build(key, frame), out)
    return blocks.groupBy("path").cogroup(runs.groupBy("path")).applyInPandas(lambda key, a, b: build(key, a, b), out)
