"""Ingest of spreadsheet workbooks as cells.

Spark lists and distributes the files (one workbook is one record); a small reader
inside the task unzips it and streams its cells out. A data source of its own reads
workbooks of any size in place, sheet by sheet. Cells arrive as text: dates and
times in ISO form, booleans as TRUE and FALSE, numbers as stored.
"""

from __future__ import annotations

import array
import datetime
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CELL_SCHEMA = "file string, sheet string, sheet_no int, row int, col int, value string"
_BATCH = 50_000
#: Fixed: numbers of the built-in formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t")


class _Strings:
    """Texts one behind the other in one buffer: little more than their bytes."""

    def __init__(self):
        self.data, self.ends = bytearray(), array.array("q", [0])

    def append(self, text: str) -> None:
        self.data += text.encode("utf-8", "surrogatepass")
        self.ends.append(len(self.data))

    def __getitem__(self, i: int) -> str:
        return self.data[self.ends[i] : self.ends[i + 1]].decode("utf-8", "surrogatepass")


def _shared_strings(z: zipfile.ZipFile) -> _Strings:
    """The workbook's string table, read as a stream."""
    out = _Strings()
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            events = ElementTree.iterparse(f, ("start", "end"))
            _, root = next(events)
            for event, element in events:
                if event == "end" and _tag(element) == "si":
                    out.append(_text(element))
                    root.clear()
    return out


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {}
    for f in root.iter():
        if _tag(f) == "numFmt":
            code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", f.get("formatCode", ""))
            own[int(f.get("numFmtId"))] = bool(re.search("[dmyhs]", code, re.IGNORECASE)) and code.lower() != "general"
    styles = next((x for x in root if _tag(x) == "cellXfs"), ())
    numbers = [int(x.get("numFmtId", 0)) for x in styles]
    return {i for i, n in enumerate(numbers) if own.get(n, n in _DATE_FORMATS)}


def _iso(serial: str, from_1904: bool) -> str:
    """ISO text of a date serial; days since the workbook's start, time as a fraction."""
    try:
        number = float(serial)
        if 0 <= number < 1:
            return (datetime.datetime.min + datetime.timedelta(seconds=round(number * 86400))).strftime("%H:%M:%S")
        start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
        # The 1900 calendar counts a day that was none, 29 February 1900.
        early = 1 if not from_1904 and number < 60 else 0
        when = start + datetime.timedelta(days=early, seconds=round(number * 86400))
    except (ValueError, OverflowError):
        return serial
    return when.strftime("%Y-%m-%d" if when.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")


def _sheets(z: zipfile.ZipFile) -> tuple[list[tuple[int, str, str]], bool]:
    """((number, name, member of the archive) of every sheet, do dates count from 1904?)."""
    links = {
        r.get("Id"): r.get("Target")
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    }
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    from_1904 = any(
        _tag(x) == "workbookPr" and x.get("date1904") in ("1", "true") for x in book.iter()
    )
    out = []
    for no, s in enumerate(x for x in book.iter() if _tag(x) == "sheet"):
        target = links[next(v for k, v in s.attrib.items() if k.endswith("}id") or k == "r:id")]
        out.append((no, s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out, from_1904


def archive_cells(z: zipfile.ZipFile, wanted=None):
    """Yield (sheet, sheet_no, row, col, value) of every non-empty cell, 0-based, of the
    sheets whose numbers are ``wanted`` (None: all); members are read as streams."""
    shared, dates = _shared_strings(z), _date_styles(z)
    sheets, from_1904 = _sheets(z)
    for no, name, path in sheets:
        if wanted is not None and no not in wanted:
            continue
        with z.open(path) as f:
            parent = None
            for event, element in ElementTree.iterparse(f, ("start", "end")):
                tag = _tag(element)
                if event == "start":
                    parent = element if tag == "sheetData" else parent
                    continue
                if tag == "row" and parent is not None:
                    parent.clear()
                if tag != "c":
                    continue
                kind, ref = element.get("t"), element.get("r")
                value = next((e.text for e in element if _tag(e) == "v"), None)
                if kind == "inlineStr":
                    value = _text(element)
                elif value is None:
                    continue
                elif kind == "s":
                    value = shared[int(value)]
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                elif kind in (None, "n") and int(element.get("s", 0)) in dates:
                    value = _iso(value, from_1904)
                row = int(re.search(r"\d+$", ref).group()) - 1
                yield name, no, row, _column_number(ref), value


def workbook_cells(content: bytes):
    """Yield (sheet, sheet_no, row, col, value) of every non-empty cell, 0-based."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        yield from archive_cells(z)


def cells_of(workbooks: DataFrame) -> DataFrame:
    """Cells of a table of workbooks (path, content)."""

    def read(batches):
        columns = ["file", "sheet", "sheet_no", "row", "col", "value"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for cell in workbook_cells(content):
                    rows.append((path, *cell))
                    if len(rows) >= _BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return workbooks.select("path", "content").mapInPandas(read, CELL_SCHEMA)


def ingest_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, sheet_no, row, col, value) of every workbook below a folder.

    A workbook is one record and has to fit a task; none is left out. Works on every
    store that Spark reads; for workbooks beyond some hundred megabytes see
    :class:`WorkbookSource`.
    """
    return cells_of(_files(spark, path))


def _files(spark, path):
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.xlsx")
        .load(path)
    )


def sheet_list(grid: DataFrame) -> DataFrame:
    """file, sheet, sheet_no, rows, columns of ingested cells."""
    return grid.groupBy("file", "sheet", "sheet_no").agg(
        (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("columns")
    )


class SheetsPartition(InputPartition):
    """Workbooks that one task reads, each with the numbers of its sheets (None: all)."""

    def __init__(self, books: list[tuple[str, tuple[int, ...] | None]]):
        super().__init__(books)
        self.books = books


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(folder)``: cells of all workbooks below it.

    Register it with ``spark.dataSource.register(WorkbookSource)``. Files are opened in
    place by the tasks (any store that Arrow opens by its address) and unzipped as
    streams, so a workbook may have any size: a task holds its string table and a batch of
    cells. A workbook above ``split`` bytes (64 MB) is read by a task per sheet; smaller
    ones share tasks up to so many bytes. ``sheets``, names separated by commas, leaves
    the other sheets unread.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELL_SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(dict(self.options))


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", 64 << 20))
        names = options.get("sheets")
        self.names = None if names is None else {n.strip() for n in names.split(",")}

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[SheetsPartition]:
        store, root = self._store()
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        books = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".xlsx"))
        out, together, size = [], [], 0
        for path, n in books:
            if n > self.split:
                with store.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                    out += [SheetsPartition([(path, (no,))]) for no, name, _ in _sheets(z)[0] if self._asked(name)]
                continue
            if together and size + n > self.split:
                out.append(SheetsPartition(together))
                together, size = [], 0
            together, size = [*together, (path, None)], size + n
        if together:
            out.append(SheetsPartition(together))
        return out or [SheetsPartition([])]

    def _asked(self, name: str) -> bool:
        return self.names is None or name in self.names

    def read(self, partition: SheetsPartition):
        store, _ = self._store()
        fields = [f.split() for f in CELL_SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for path, wanted in partition.books:
            rows = []
            with store.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                chosen = {no for no, name, _ in _sheets(z)[0] if self._asked(name) and (wanted is None or no in wanted)}
                for cell in archive_cells(z, chosen) if chosen else ():
                    rows.append((path, *cell))
                    if len(rows) >= _BATCH:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)
