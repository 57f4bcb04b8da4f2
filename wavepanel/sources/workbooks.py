"""Workbooks (.xlsx) as a source and a sink (A2).

Reading: Spark's `binaryFile` source lists the files and brings each one's bytes
to a task, whatever store they lie in; the task streams the zipped XML -- shared
strings, styles, then the sheet row by row -- and gives every row as text cells.
What it holds is the workbook's (compressed) bytes, its shared strings and a
batch of rows.

Writing: `df.write.format("workbook")`, a Python data source.  Each task streams
its rows into sheets; files appear under their names only when the job commits.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BATCH_ROWS = 4096
BATCH_BYTES = 16 << 20
# Fixed values of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
STRICT = "{http://purl.oclc.org/ooxml/spreadsheetml/main}"
RELATION = ("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id",
            "{http://purl.oclc.org/ooxml/officeDocument/relationships}id")
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}     # built-in number formats of dates and times
MAX_SHEET_ROWS = 1_048_576
PIECE_BYTES = 1 << 16
WRITE_ROWS = 64                          # rows given to the archive at once
LEVEL = 3                                # deflate: cells repeat their markup, higher levels take longer for little
ROWS = "uri string, sheet string, pos long, cells array<string>"


@lru_cache(1024)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


@lru_cache(1 << 15)
def _column(ref: str) -> int:
    """Column number (from 0) of a cell reference such as AB12."""
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _text(node) -> str:
    """The text of a string item: its own or its runs', without phonetic hints; _xHHHH_ stands for a character."""
    if len(node) == 1 and _local(node[0].tag) == "t":
        parts = [node[0].text or ""]
    else:
        parts = [t.text or "" for child in node for t in ([child] if _local(child.tag) == "t" else
                 [x for x in child if _local(x.tag) == "t"] if _local(child.tag) == "r" else [])]
    text = "".join(parts)
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _is_date_format(code: str) -> bool:
    """A number format with a date or time part outside quotes, escapes and brackets."""
    return re.search(r"[dmhysDMHYS]", re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|General', "", code)) is not None


@lru_cache(1 << 14)
def _when(serial: float, from_1904: bool) -> str:
    """A date serial as ISO text: the date alone at midnight, the time alone below one day."""
    if from_1904:
        base = dt.datetime(1904, 1, 1)
    else:                                                   # the format counts a 29 February 1900 that never was
        base = dt.datetime(1899, 12, 31 if serial < 60 else 30)
    at = base + dt.timedelta(milliseconds=round(serial * 86_400_000))
    if 0 <= serial < 1 and not from_1904:
        return at.time().isoformat()
    return at.date().isoformat() if at.time() == dt.time() else at.isoformat(sep=" ")


class Workbook:
    """A workbook's sheets, streamed."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        main = next((self._target("", r.get("Target")) for r in self._nodes("_rels/.rels", "Relationship")
                     if r.get("Type", "").endswith("/officeDocument")), "xl/workbook.xml")
        folder, file = posixpath.split(main)
        links = {r.get("Id"): r for r in self._nodes(f"{folder}/_rels/{file}.rels", "Relationship")}
        part = lambda kind: next((self._target(folder, r.get("Target")) for r in links.values()
                                  if r.get("Type", "").endswith(kind)), None)
        self.from_1904 = any(n.get("date1904") in ("1", "true") for n in self._nodes(main, "workbookPr"))
        self.sheets = [(n.get("name"), self._target(folder, links[rid].get("Target"))) for n in self._nodes(main, "sheet")
                       if (rid := n.get(RELATION[0]) or n.get(RELATION[1])) in links
                       and links[rid].get("Type", "").endswith("/worksheet")]
        self.strings = [_text(n) for n in self._nodes(part("/sharedStrings"), "si")]
        self.dates = self._date_styles(part("/styles"))

    @staticmethod
    def _target(folder: str, target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))

    def _nodes(self, part: str | None, name: str) -> Iterator:
        """Elements `name` of a part, in order; each is forgotten after use."""
        if part is None or part not in self.names:
            return
        with self.zip.open(part) as f:
            open_ = []
            for event, node in ET.iterparse(f, ("start", "end")):
                if event == "start":
                    open_.append(node)
                    continue
                open_.pop()
                if _local(node.tag) == name:
                    yield node
                    if open_:
                        open_[-1].remove(node)

    def _date_styles(self, part: str | None) -> set[int]:
        """Numbers of the cell styles that show dates."""
        custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in self._nodes(part, "numFmt")}
        for block in self._nodes(part, "cellXfs"):
            styles = [int(x.get("numFmtId") or 0) for x in block if _local(x.tag) == "xf"]
            return {i for i, f in enumerate(styles) if (_is_date_format(custom[f]) if f in custom else f in DATE_FORMATS)}
        return set()

    def _value(self, cell) -> str | None:
        kind = cell.get("t", "n")
        inner = {_local(x.tag): x for x in cell}
        if kind == "inlineStr":
            return _text(inner["is"]) if "is" in inner else None
        raw = inner["v"].text if "v" in inner else None
        if raw is None or kind == "e":                      # an error value is no value
            return None
        if kind == "s":
            return self.strings[int(raw)]
        if kind == "b":
            return "true" if raw in ("1", "true") else "false"
        if kind == "n" and int(cell.get("s") or 0) in self.dates:
            return _when(float(raw), self.from_1904)
        if kind == "d":
            return raw.replace("T", " ").removesuffix(" 00:00:00")
        return raw

    def _sheet(self, part: str) -> Iterator:
        """Row elements of a sheet, in order; each is forgotten after use.  As `_nodes`,
        but looks at the tree after every piece of the file instead of at every cell."""
        if part not in self.names:
            return
        tree = ET.TreeBuilder()
        top, parser, data = tree.start("file", {}), ET.XMLParser(target=tree), None
        with self.zip.open(part) as f:
            while piece := f.read(PIECE_BYTES):
                parser.feed(piece)
                if data is None and len(top):
                    data = next((x for x in top[0] if _local(x.tag) == "sheetData"), None)
                if data is not None and len(data) > 1:      # the last one may not be whole
                    done = data[:-1]
                    del data[:-1]
                    yield from (x for x in done if _local(x.tag) == "row")
        tree.end("file")
        parser.close()
        yield from (x for x in (data if data is not None else []) if _local(x.tag) == "row")

    def rows(self, part: str) -> Iterator[list[str | None]]:
        """Rows of a sheet as lists of cells; an absent row in between is an empty list."""
        at = 0
        for node in self._sheet(part):
            number = int(node.get("r") or at + 1)
            for _ in range(at + 1, number):
                yield []
            at, cells = number, []
            for cell in node:
                if _local(cell.tag) != "c":
                    continue
                ref = cell.get("r")
                column = _column(ref.rstrip("0123456789")) if ref else len(cells)
                cells += [None] * (column - len(cells))
                cells.append(self._value(cell))
            yield cells


def sheet_rows(data: bytes, sheet: int | str | None = 0) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, position, cells): the header has position -1, the first row that has
    a value; the rows after it count from 0.  Rows without a value before the
    header and at the end are left out, those in between are kept.  `sheet` is a
    number, a name or None for all."""
    book = Workbook(data)
    wanted = book.sheets if sheet is None else [s for i, s in enumerate(book.sheets) if sheet in (i, s[0])]
    if not wanted:
        raise ValueError(f"no sheet {sheet!r} among {[s for s, _ in book.sheets]}")
    for name, part in wanted:
        pos, blank = None, 0
        for cells in book.rows(part):
            if all(c is None or c == "" for c in cells):
                blank += pos is not None
                continue
            for k in range(blank):
                yield name, pos + k, []
            pos = -1 if pos is None else pos + blank
            yield name, pos, cells
            pos, blank = pos + 1, 0


def read_workbooks(files: DataFrame, sheet: int | str | None = 0) -> DataFrame:
    """(uri, sheet, pos, cells) of the rows of workbooks.  `files` has `uri` and
    `content` (the `binaryFile` source).  A file that is no workbook is an error
    that names it."""
    _bounded(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("uri", pa.string()), ("sheet", pa.string()), ("pos", pa.int64()), ("cells", pa.list_(pa.string()))])
        for batch in batches:
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = []
                try:
                    for row in sheet_rows(content.as_py(), sheet):
                        out.append((uri, *row))
                        if len(out) == BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.types)], schema=types)
                            out = []
                except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError) as e:
                    raise ValueError(f"{uri}: not a readable workbook ({type(e).__name__}: {e})") from e
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.types)], schema=types)

    return files.select("uri", "content").mapInArrow(run, ROWS)


def _bounded(spark: SparkSession) -> None:
    """Arrow batches of few bytes: a batch of whole files has no bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


# --------------------------------------------------------------------------- sink

def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, v) -> str:
    """A cell's XML; nothing for null and NaN.  Dates are serials in the date style (1), times of day keep their fraction (2)."""
    if type(v) is str:
        return f'<c r="{ref}"{_text_cell(v)}'
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, dt.datetime):
        days = (v.replace(tzinfo=None) - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
        return f'<c r="{ref}" s="2"><v>{days!r}</v></c>' if days >= 61 else _cell(ref, v.isoformat(sep=" "))
    if isinstance(v, dt.date):
        days = (v - dt.date(1899, 12, 30)).days
        return f'<c r="{ref}" s="1"><v>{days}</v></c>' if days >= 61 else _cell(ref, v.isoformat())
    if isinstance(v, (int, float)) and abs(v) != float("inf"):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}"{_text_cell(str(v))}'


@lru_cache(1 << 14)
def _text_cell(text: str) -> str:
    """What follows the reference in a text cell."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    text = re.sub(r"[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text)
    return f' t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


_FIXED_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{RELATION[0][1:-3]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


class SheetFile:
    """One workbook being written: a header, then rows, streamed into the archive."""

    def __init__(self, stream, columns: list[str]):
        self.zip, self.columns = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL), columns
        self.letters, self.waiting = [_letters(i) for i in range(len(columns))], []
        for name, body in _FIXED_PARTS.items():
            self.zip.writestr(name, body)
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
        self.rows = 0
        self.add(columns)

    def add(self, values) -> None:
        self.rows += 1
        cells = "".join([_cell(f"{letters}{self.rows}", v) for letters, v in zip(self.letters, values)])
        self.waiting.append(f'<row r="{self.rows}">{cells}</row>')
        if len(self.waiting) == WRITE_ROWS:
            self._flush()

    def _flush(self) -> None:
        self.sheet.write("".join(self.waiting).encode())
        self.waiting = []

    def close(self) -> None:
        self._flush()
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()


@dataclass
class Written(WriterCommitMessage):
    files: list


class WorkbookWriter(DataSourceArrowWriter):
    """Writes rows to `<name> <task>.xlsx` in the folder `path`; the column named by
    option `file` gives the name (rows of one name should follow each other in a
    task) and is not written.  Sheets hold `rows` rows at most (default: the
    format's limit); further rows go to further files."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.file = options["path"], options.get("file")
        self.limit = min(int(options.get("rows", MAX_SHEET_ROWS)), MAX_SHEET_ROWS - 1)
        self.columns = [f.name for f in schema if f.name != self.file]
        self.job = uuid.uuid4().hex[:12]

    def _store(self):
        from pyarrow import fs
        path = self.folder if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", self.folder) else "file://" + self.folder
        return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext
        store, root = self._store()
        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        staged = f"{root}/_temporary-{self.job}"
        store.create_dir(staged, recursive=True)
        done, book, stream, key, count = [], None, None, None, {}

        def finish():
            if book is not None:
                book.close()
                stream.close()

        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in self.columns]
            names = batch.column(self.file).to_pylist() if self.file else ["part"] * batch.num_rows
            for name, *values in zip(names, *columns):
                if book is None or name != key or book.rows > self.limit:
                    finish()
                    n = count[name] = count.get(name, -1) + 1
                    final = f"{name} {task:05d}" + (f"-{n}" if n else "") + ".xlsx"
                    stream = store.open_output_stream(f"{staged}/{attempt}-{len(done)}.xlsx")
                    done.append((f"{staged}/{attempt}-{len(done)}.xlsx", f"{root}/{final}"))
                    book, key = SheetFile(stream, self.columns), name
                book.add(values)
        finish()
        return Written(done)

    def commit(self, messages: list) -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        for message in messages:
            for staged, final in (message.files if message else []):
                store.move(staged, final)
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*self._store())

    def _clear(self, store, root) -> None:
        from pyarrow import fs
        staged = f"{root}/_temporary-{self.job}"
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)


class WorkbookSource(DataSource):
    """`df.write.format("workbook").option("file", column).mode("append").save(folder)` after `register(spark)`."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        if overwrite:
            raise ValueError("workbooks are only appended to a folder")
        return WorkbookWriter(dict(self.options), schema)


def write_workbooks(df: DataFrame, folder: str, file: str | None = None, rows: int = MAX_SHEET_ROWS) -> None:
    """A workbook per value of column `file` and task (one per task without it)."""
    spark = df.sparkSession
    spark.dataSource.register(WorkbookSource)
    if file:
        df = df.hint("rebalance", file).sortWithinPartitions(file)      # a large snapshot is split over tasks
    out = df.write.format("workbook").option("path", folder).option("rows", rows)
    (out.option("file", file) if file else out).mode("append").save()
