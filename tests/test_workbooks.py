"""Workbooks: cells of every kind, files of both layouts against their CSV twins, many files, bounded memory."""

import datetime as dt
import io
import os
import tempfile
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from wavepanel.sources import fixtures
from wavepanel.sources.snapshots import column_plan, layout_frames, read_snapshots
from wavepanel.sources.workbooks import SheetFile, Workbook, _is_date_format, read_workbooks, sheet_rows, write_workbooks

from .conftest import SF001

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _scratch():
    return tempfile.mkdtemp(prefix="wavepanel-test-")


def made(sheets, strings="", styles="", date1904=False, absolute=False):
    """A workbook put together by hand: {sheet name: XML of its rows}."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        root = "/xl/" if absolute else ""
        links = "".join(f'<Relationship Id="r{i}" Type="{REL}/worksheet" Target="{root}worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("_rels/.rels", f'<Relationships><Relationship Id="a" Type="{REL}/officeDocument" Target="{"/" if absolute else ""}xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships>{links}<Relationship Id="s" Type="{REL}/sharedStrings" Target="sharedStrings.xml"/>'
                   f'<Relationship Id="t" Type="{REL}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="{REL}"><workbookPr{" date1904=\"1\"" if date1904 else ""}/><sheets>'
                   + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">{strings}</sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{NS}">{styles}</styleSheet>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{NS}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


STRINGS = ("<si><t>Last Name</t></si><si><r><t>First</t></r><r><t xml:space=\"preserve\"> Name</t></r><rPh><t>no</t></rPh></si>"
           "<si><t>line_x000A_two</t></si><si><t/></si>")
STYLES = ('<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm;@"/><numFmt numFmtId="171" formatCode="&quot;days&quot; 0.0"/></numFmts>'
          '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs>')


def test_cells_of_every_kind():
    rows = ('<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>x</t></is></c></row>'
            '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3"><v>62000.5</v></c><c r="D3" t="b"><v>1</v></c><c r="E3" t="e"><v>#N/A</v></c></row>'
            '<row r="5"><c r="A5" s="1"><v>45292</v></c><c r="B5" s="2"><v>1</v></c><c r="C5" s="3"><v>45292</v></c><c r="D5" s="4"><v>45292.75</v></c>'
            '<c r="E5" t="str"><f>A1</f><v>made</v></c><c r="F5" t="d"><v>2024-02-29T00:00:00</v></c></row>'
            '<row><c t="s"><v>3</v></c><c><v>7</v></c></row><row r="9"><c r="A9" t="s"><v>3</v></c></row>')
    got = list(sheet_rows(made({"One": rows}, STRINGS, STYLES)))
    assert got == [("One", -1, ["Last Name", "First Name", None, "x"]), ("One", 0, ["line\ntwo", None, "62000.5", "true", None]), ("One", 1, []),
                   ("One", 2, ["2024-01-01", "1900-01-01", "45292", "2024-01-01 18:00:00", "made", "2024-02-29"]), ("One", 3, ["", "7"])]
    other = list(sheet_rows(made({"One": "", "Two": rows}, STRINGS, STYLES, date1904=True, absolute=True), "Two"))
    assert other[3][2][0] == "2028-01-02" and other[0][0] == "Two"
    assert len(list(sheet_rows(made({"A": rows, "B": rows}, STRINGS, STYLES), None))) == 10
    assert list(sheet_rows(made({"Empty": ""}))) == []
    with pytest.raises(ValueError, match="no sheet"):
        list(sheet_rows(made({"A": ""}), "B"))


def test_date_formats():
    assert [_is_date_format(f) for f in ("yyyy-mm-dd", "h:mm", "[$-409]d/m/yy", '0 "days"', "#,##0.00", "General", "[Red]0", "\\d0")] == \
        [True, True, True, False, False, False, False, False]


def test_written_cells_come_back():
    out = io.BytesIO()
    f = SheetFile(out, ["a", "b"])
    rows = [("x & <y>", 1.5), (" lead", -3), ("_x0041_", True), ("nul\x01", None), (dt.date(2024, 2, 29), dt.datetime(2024, 1, 1, 6)),
            (dt.date(1899, 1, 1), float("inf")), (None, float("nan")), ("end", 1e300)]
    for r in rows:
        f.add(r)
    f.close()
    got = [c for _, _, c in sheet_rows(out.getvalue())]
    assert got == [["a", "b"], ["x & <y>", "1.5"], [" lead", "-3"], ["_x0041_", "true"], ["nul\x01"], ["2024-02-29", "2024-01-01 06:00:00"],
                   ["1899-01-01", "inf"], [], ["end", "1e+300"]]


def test_a_long_sheet_is_streamed():
    out = io.BytesIO()
    f = SheetFile(out, ["name", "amount", "note"])
    for i in range(60_000):
        f.add((f"name {i % 50}", i, "some words that make the row longer " * 3))
    f.close()
    data = out.getvalue()
    size = sum(i.file_size for i in zipfile.ZipFile(io.BytesIO(data)).infolist())
    tracemalloc.start()
    n = sum(1 for _ in sheet_rows(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_001 and size > 10e6 and peak < size / 4



def test_workbooks_equal_their_csv_twins(spark):
    """Both layouts, three files a snapshot: same rows, same row numbers."""
    raw = fixtures.raw_snapshots(spark, SF001).where("_row_seq % 5 = 0")
    books, texts = _scratch(), _scratch()
    for frame in layout_frames(raw, fixtures.NEW_LAYOUT_FROM):
        named = (frame.withColumn("file", F.concat(F.lit("Pay "), F.date_format("Date", "yyyy-MM"), F.lit(" p"), F.pmod("_row_seq", F.lit(3))))
                 .drop("Date", "_row_seq").repartition(1).sortWithinPartitions("file", "Last Name", "First Name", "Title", "Annual Full Salary"
                                                                              if "Annual Full Salary" in frame.columns else "Annualized Rate Amount").cache())
        write_workbooks(named.withColumn("Date of Hire", F.col("Date of Hire").cast("date")), books, file="file")
        named.write.mode("append").partitionBy("file").option("header", True).csv(texts)
    assert all(f.endswith(".xlsx") for f in os.listdir(books)) and len(os.listdir(books)) == 21
    a, b = read_snapshots(spark, books, "xlsx"), read_snapshots(spark, texts)
    assert a.columns == b.columns and a.dtypes == b.dtypes
    drop = lambda df: sorted(map(str, df.drop("_row_seq").collect()))
    assert a.count() == raw.count() and drop(a) == drop(b)
    for df in (a, b):
        assert sorted(r._row_seq for r in df.collect()) == list(range(raw.count()))
    key = lambda df: [(r.Date, r.last_name) for r in df.orderBy("_row_seq").collect()]
    assert sorted(key(a)) == sorted(key(b)) and [d for d, _ in key(a)] == sorted(d for d, _ in key(a))


def test_row_limit_starts_another_file_and_bad_files_are_named(spark):
    folder = _scratch()
    write_workbooks(spark.range(25).select(F.col("id").alias("Last Name"), F.lit("2025-09 x").alias("f")).coalesce(1), folder, file="f", rows=10)
    assert sorted(os.listdir(folder)) == ["2025-09 x 00000-1.xlsx", "2025-09 x 00000-2.xlsx", "2025-09 x 00000.xlsx"]
    assert sorted(int(r.last_name) for r in read_snapshots(spark, folder, "xlsx").collect()) == list(range(25))
    open(os.path.join(folder, "~$2025-09 lock.xlsx"), "w").close()
    assert read_snapshots(spark, folder, "xlsx").count() == 25
    with open(os.path.join(folder, "2025-10 broken.xlsx"), "wb") as f:
        f.write(b"PK nothing")
    with pytest.raises(Exception, match="2025-10.*not a readable workbook"):
        read_snapshots(spark, folder, "xlsx").collect()
    with pytest.raises(ValueError, match="no snapshot files"):
        empty = _scratch()
        write_workbooks(spark.range(3).select(F.lit("no month").alias("f"), F.col("id").alias("Last Name")), empty, file="f")
        read_snapshots(spark, empty, "xlsx")


def test_sheets_as_rows(spark):
    folder = _scratch()
    with open(os.path.join(folder, "two.xlsx"), "wb") as f:
        f.write(made({"A": '<row r="1"><c r="A1"><v>1</v></c></row>', "B": '<row r="1"><c r="B1"><v>2</v></c></row><row r="2"><c r="A2"><v>3</v></c></row>'}))
    files = spark.read.format("binaryFile").load(folder).withColumn("uri", F.col("path"))
    got = [(r.sheet, r.pos, r.cells) for r in read_workbooks(files, sheet=None).orderBy("sheet", "pos").collect()]
    assert got == [("A", -1, ["1"]), ("B", -1, [None, "2"]), ("B", 0, ["3"])]


def test_column_plan():
    assert column_plan(["Last Name", "FTE", "Pay Rate Type", "Annualized Rate Amount", "Annual Full Salary", "Title", "Title", ""]) == {
        "current_annual_contracted_salary": [4, 3], "full_time_equivalent": [1], "last_name": [0], "pay_rate_type": [2], "title": [5], "title.1": [6], "unnamed:_7": [7]}


def test_parquet_exports_of_differing_types(spark):
    folder = _scratch()
    spark.createDataFrame([("a", 1, "10")], "`Last Name` string, `Full-Time Equivalent` int, `Annual Full Salary` string").write.parquet(f"{folder}/Pay 2025-09")
    spark.createDataFrame([("b", 0.5, 20.25, dt.date(2020, 1, 2))], "`last name` string, FTE double, `Annualized Rate Amount` double, `Date of Hire` date") \
        .withColumn("Pay Rate Type", F.lit("S")).write.parquet(f"{folder}/Pay 2025-10")
    got = read_snapshots(spark, folder, "parquet").orderBy("_row_seq").collect()
    assert [(r.last_name, r.full_time_equivalent, r.current_annual_contracted_salary, r.date_of_hire, r._row_seq) for r in got] == \
        [("a", 1.0, 10.0, None, 0), ("b", 0.5, 20.25, dt.date(2020, 1, 2), 1)]


def test_thousands_of_files(spark):
    """One frame out of 3,000 files of 30 layouts, without a list of files in the plan or on the driver."""
    folder = _scratch()
    for k in range(3000):
        with open(os.path.join(folder, f"Pay {2000 + k % 25}-{k % 12 + 1:02d} {k:05d}.csv"), "w") as f:
            f.write(f"Last Name,X{k % 30},Annual Full Salary\n{k},x,{k}.5\n")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "65536")
    try:
        df = read_snapshots(spark, folder)
        assert {f"x{i}" for i in range(30)} <= set(df.columns)
        got = df.agg(F.count("*").alias("n"), F.countDistinct("_row_seq").alias("d"), F.max("_row_seq").alias("m"),
                     F.sum("current_annual_contracted_salary").alias("s")).first()
        assert tuple(got) == (3000, 3000, 2999, 3000 * 2999 / 2 + 1500)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert "SinglePartition" not in plan and plan.count(".csv") < 10
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_workbook_class_reads_no_sheet_twice():
    book = Workbook(made({"A": '<row r="1"><c r="A1"><v>1</v></c></row>'}))
    assert [n for n, _ in book.sheets] == ["A"] and list(book.rows(book.sheets[0][1])) == [["1"]]


def test_sheets_are_read_by_pieces_not_by_elements(monkeypatch):
    """Rows cut anywhere by the pieces of the file come whole, without an event per cell."""
    import io

    from wavepanel.sources import workbooks as W
    stream = io.BytesIO()
    book = W.SheetFile(stream, ["a", "b"])
    rows = [(f"x{i}<&_x0041_", None if i % 3 else float(i)) for i in range(300)]
    for r in rows:
        book.add(r)
    book.close()
    nodes = W.Workbook._nodes

    def no_rows(self, part, name):
        assert name != "row"
        return nodes(self, part, name)

    monkeypatch.setattr(W.Workbook, "_nodes", no_rows)
    want = [("Sheet1", -1, ["a", "b"])] + [("Sheet1", i, [r[0]] + ([repr(r[1])] if r[1] is not None else [])) for i, r in enumerate(rows)]
    for size in (1, 97, 1 << 16):
        monkeypatch.setattr(W, "PIECE_BYTES", size)
        assert list(W.sheet_rows(stream.getvalue())) == want
