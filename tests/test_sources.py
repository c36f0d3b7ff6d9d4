"""Files, the store, workbooks."""

from pyspark.sql import functions as F

import pytest

from gridwash.sources import store, tables, workbooks


def test_raw_table_keeps_file_order(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(f"{i},x{i}" for i in range(500)), encoding="utf8")
    df = tables.read_raw_table(spark, str(path))
    assert [r["c0"] for r in df.orderBy("row_id").collect()] == [str(i) for i in range(500)]
    assert dict(df.dtypes) == {"row_id": "bigint", "c0": "string", "c1": "string"}


def test_resolve_table(spark):
    cat = spark.createDataFrame([("Sales", 0), ("sales", 1), ("Other", 2)], "name string, position int")
    pick = lambda n: tuple(tables.resolve_table(cat, n).first())
    assert pick("sales") == ("sales", 0) and pick("SALES") == ("Sales", 1) and pick("none") == ("Sales", 2)


def test_write_table_leaves_other_sheets(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", "s1"), (2, "b", "s2")], "v int, dataset string, sheet string")
    tables.write_table(df, str(tmp_path / "t"))
    tables.write_table(df.where("v = 1").withColumn("v", F.lit(9)), str(tmp_path / "t"))
    got = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r["v"], r["sheet"]) for r in got.collect()) == [(2, "s2"), (9, "s1")]


def test_store_round_trip(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    store.write_stage(df, root, "My Book.xlsx", "", "uploads", "id1")
    store.write_stage(df.withColumn("v", F.lit("clean")), root, "My Book.xlsx", "", "cleaned", "id1")
    store.write_stage(df.withColumn("v", F.lit("cleaner")), root, "My Book.xlsx", "", "cleaned", "id1")
    got = store.read_stage(spark, root, "My_Book", "default_sheet", "cleaned", "id1").collect()
    assert [tuple(r) for r in got] == [(1, "cleaner")]
    files = store.read_stage(spark, root, "My_Book", "default_sheet", "cleaned").inputFiles()
    assert files and all("/stage=cleaned/" in f for f in files)
    meta = store.read_metadata(spark, root).collect()
    assert len(meta) == 1 and meta[0]["dataset"] == "My_Book" and meta[0]["last_cleaned"]
    info = store.dataset_info(
        spark.createDataFrame([("b/s/uploads/1.xlsx", 5), ("b/s/metadata/1.json", 2)], "path string, length bigint")
    ).first()
    assert info["original_file_exists"] and not info["cleaned_file_exists"] and info["original_file_size"] == 5


def test_sanitize(spark):
    names = ["My Book.xlsx", "a__b.xls", "_x-y_", "é t", "a.xlsx.xlsx"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(store.sanitize_name("n")).collect()]
    assert got == ["My_Book", "a_b", "x-y", "é_t", "a_xlsx"]


def test_workbook_files(spark, tmp_path):
    from registry.sources import _workbook

    rows = [["Name", "N"], ["x & y", 3], [None, 45292.0], [True, 0.25], ["x & y", 1.0]]
    (tmp_path / "a.xlsx").write_bytes(_workbook(rows, "n"))
    (tmp_path / "note.txt").write_text("no")
    got = workbooks.ingest_workbooks(spark, str(tmp_path)).orderBy("sheet_no", "row", "col").collect()
    assert [(r["sheet"], r["row"], r["col"], r["value"]) for r in got] == [
        ("Data", 0, 0, "Name"), ("Data", 0, 1, "N"), ("Data", 1, 0, "x & y"), ("Data", 1, 1, "3"), ("Data", 2, 1, "2024-01-01"),
        ("Data", 3, 0, "TRUE"), ("Data", 3, 1, "06:00:00"), ("Data", 4, 0, "x & y"), ("Data", 4, 1, "1900-01-01"), ("Notes", 2, 1, "n")]
    data = workbooks.ingest_workbooks(spark, str(tmp_path)).where("sheet_no = 0")
    wide = tables.cells_to_table(data, 2).orderBy("row").collect()
    assert tuple(wide[2]) == (2, None, "2024-01-01")


def test_raw_tables_keep_every_cell(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Report 2024\na,b,c\n1,"x\ny, ""z""",3,,,,,,,,,,13\n,,\n')
    got = tables.read_raw_table(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["row_id", *[f"c{i}" for i in range(13)]]
    rows = [tuple(r)[1:4] + (r["c12"],) for r in got.orderBy("row_id").collect()]
    assert rows == [("Report 2024", None, None, None), ("a", "b", "c", None), ("1", 'x\ny, "z"', "3", "13"), (None, None, None, None)]


def test_store_keeps_tables_apart(spark, tmp_path):
    root = str(tmp_path)
    store.write_stage(spark.createDataFrame([(1, "x")], "a int, b string"), root, "Book 1.xlsx", "S", "uploads", "001")
    store.write_stage(spark.createDataFrame([(2.5, None)], "price double, q string"), root, "Book 1.xlsx", "S", "uploads", "1")
    one = store.read_stage(spark, root, "Book 1.xlsx", "S", "uploads", "001")
    assert one.columns == ["a", "b"] and one.collect() == [(1, "x")]
    assert store.read_stage(spark, root, "Book_1", "S", "uploads", "1").collect() == [(2.5, None)]
    assert store.read_stage(spark, root, "Book 1.xls", "S", "uploads").count() == 2


@pytest.mark.parametrize("split", [1, 1 << 20])
def test_workbook_source_equals_ingest(spark, tmp_path, split):
    from registry.sources import _workbook

    (tmp_path / "deep").mkdir()
    for k in range(4):
        rows = [["A", "B & C", "é"], [f"text {k}", 12, None], [True, 45292.5, "text 1"]]
        (tmp_path / "deep" / f"b{k}.xlsx").write_bytes(_workbook(rows, f"note {k}"))
    (tmp_path / "other.txt").write_text("no workbook")
    spark.dataSource.register(workbooks.WorkbookSource)
    read = lambda **o: spark.read.format("workbook").options(split=split, **o).load(str(tmp_path))
    plain = lambda df: sorted((r.file.rsplit("/", 1)[1], *tuple(r)[1:]) for r in df.collect())
    whole = plain(workbooks.ingest_workbooks(spark, str(tmp_path)))
    assert plain(read()) == whole and len(whole) > 20
    # A sheet is a task; together they are one.
    assert read().rdd.getNumPartitions() == (8 if split == 1 else 1)
    notes = [r for r in whole if r[1] == "Notes"]
    assert plain(read(sheets="Notes")) == notes
    assert read(sheets="no such").count() == 0
    (tmp_path / "empty").mkdir()
    assert spark.read.format("workbook").load(str(tmp_path / "empty")).count() == 0


def test_large_sheets_are_streamed(spark, tmp_path):
    """The task's memory follows the batch and the string table, not the sheet."""
    import tracemalloc
    import zipfile

    from registry.sources import _workbook

    row = '<row r="{0}"><c r="A{0}"><v>{0}</v></c><c r="B{0}"><v>1.5</v></c><c r="C{0}" t="b"><v>1</v></c></row>'
    path = tmp_path / "big.xlsx"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, zipfile.ZipFile(__import__("io").BytesIO(_workbook([["x"]], "n"))) as small:
        for name in small.namelist():
            if name != "xl/worksheets/sheet1.xml":
                z.writestr(name, small.read(name))
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for lo in range(0, 120_000, 1000):
                out.write("".join(row.format(i + 1) for i in range(lo, lo + 1000)).encode())
            out.write(b"</sheetData></worksheet>")
    reader = workbooks.WorkbookReader({"path": str(path), "split": "1"})
    tracemalloc.start()
    cells = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cells == 360_001 and peak < 60 << 20
    spark.dataSource.register(workbooks.WorkbookSource)
    assert spark.read.format("workbook").load(str(path)).where("col = 0").agg({"row": "max"}).first()[0] == 119_999
