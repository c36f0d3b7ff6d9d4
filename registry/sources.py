"""Queries of the sources and sinks (S). Files go to a fresh folder of the shared
checkpoint root and are read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from gridwash.session import scratch_path
from gridwash.operators import profile
from gridwash.sources import sketches, store, tables, workbooks
from registry.base import query

SUPPLIER = "SELECT s_name, CAST(s_suppkey AS STRING) AS k, CAST(s_nationkey AS STRING) AS n FROM {supplier}"


@query(
    "s01_read_raw_table",
    "SELECT s_name AS c0, CASE WHEN s_suppkey % 10 = 0 THEN concat(CAST(s_suppkey AS VARCHAR), ', \"a\"', chr(10), 'b') ELSE CAST(s_suppkey AS VARCHAR) END AS c1, "
    "CAST(s_nationkey AS VARCHAR) AS c2, CASE WHEN s_suppkey % 7 = 0 THEN 'extra' END AS c3 FROM supplier "
    "UNION ALL SELECT 'Report 2024', NULL, NULL, NULL",
)
def s01(d):
    """A narrow title line above wider, ragged rows, some with a line break in a cell."""
    path = scratch_path(d.spark, "raw")
    lines = d.sql(
        """SELECT 'Report 2024' AS line, -1 AS k UNION ALL SELECT concat(s_name, ',',
        CASE WHEN s_suppkey % 10 = 0 THEN concat('"', s_suppkey, ', ""a""\\n', 'b"') ELSE CAST(s_suppkey AS STRING) END,
        ',', s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN ',extra' ELSE '' END), s_suppkey FROM {supplier}"""
    )
    lines.repartitionByRange(1, "k").sortWithinPartitions("k").select("line").write.text(path)
    return tables.read_raw_table(d.spark, path).drop("row_id")


@query("s01_read_raw_folder", "SELECT s_name AS c0, CAST(s_suppkey AS VARCHAR) AS c1, CAST(s_nationkey AS VARCHAR) AS c2 FROM supplier")
def s01_folder(d):
    path = scratch_path(d.spark, "rawdir")
    d.sql(SUPPLIER).repartition(3, "n").write.csv(path)
    return tables.read_raw_folder(d.spark, path, 3).drop("file", "row_id")


@query(
    "s01_read_raw_folder_quoted",
    "SELECT s_name AS c0, CASE WHEN s_suppkey % 10 = 0 THEN concat(CAST(s_suppkey AS VARCHAR), ', \"a\"', chr(10), 'b') ELSE CAST(s_suppkey AS VARCHAR) END AS c1, "
    "CAST(s_nationkey AS VARCHAR) AS c2, CASE WHEN s_suppkey % 7 = 0 THEN 'extra' END AS c3 FROM supplier",
)
def s01_folder_quoted(d):
    """Many files of ragged rows, some with a line break in a cell; the widest row decides."""
    path = scratch_path(d.spark, "rawdir")
    lines = d.sql(
        """SELECT concat(s_name, ',', CASE WHEN s_suppkey % 10 = 0 THEN concat('"', s_suppkey, ', ""a""\\n', 'b"') ELSE CAST(s_suppkey AS STRING) END,
        ',', s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN ',extra' ELSE '' END) AS line, s_suppkey FROM {supplier}"""
    )
    lines.repartition(4, "s_suppkey").select("line").write.text(path)
    return tables.read_raw_folder(d.spark, path).drop("file", "row_id")


@query("s02_read_table", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s02(d):
    path = scratch_path(d.spark, "typed")
    tables.write_csv(d.table("supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return tables.read_table(d.spark, path, "csv", "s_suppkey bigint, s_name string, s_acctbal double")


@query("s02_read_table_json", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s02_json(d):
    path = scratch_path(d.spark, "json")
    d.table("supplier").select("s_suppkey", "s_name", "s_acctbal").write.json(path)
    return tables.read_table(d.spark, path, "json", "s_suppkey bigint, s_name string, s_acctbal double")


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _workbook(rows, note: str) -> bytes:
    """A minimal workbook of two sheets: shared strings, numbers, booleans, dates; one note."""
    shared: dict[str, int] = {}

    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r + 1}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            return f'<c r="{ref}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'
        if isinstance(v, float):
            return f'<c r="{ref}" s="1"><v>{v:g}</v></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'

    body = "".join(
        f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(row)) + "</row>"
        for i, row in enumerate(rows)
    )
    inline = f'<row r="3"><c r="B3" t="inlineStr"><is><t>{escape(note)}</t></is></c></row>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/>'
        '<sheet name="Notes" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        + "".join(f'<Relationship Id="rId{i}" Type="{RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2))
        + "</Relationships>",
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><numFmts count="1"><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts>'
        '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{inline}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in shared) + "</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def write_workbooks(d) -> str:
    """Files of 200 suppliers each, written by the tasks into a shared folder."""
    root = scratch_path(d.spark, "books")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s_suppkey")
        book = int(pdf["book"].iloc[0])
        rows = [["Name", "Key", "Rich", "Since"]]
        rows += [[n, int(k), bool(b > 0), 45292.0 + k] for n, k, b in zip(pdf["s_name"], pdf["s_suppkey"], pdf["s_acctbal"])]
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder)
        # A task that runs again writes the same file again.
        with store.open_output_stream(f"{folder}/book_{book}.xlsx") as out:
            out.write(_workbook(rows, f"book {book} & more"))
        return pd.DataFrame({"book": [book]})

    keyed = d.table("supplier").select(
        "s_suppkey", "s_name", "s_acctbal", F.floor(F.col("s_suppkey") / 200).alias("book")
    )
    keyed.groupBy("book").applyInPandas(pack, "book long").count()
    return root


def supplier_workbooks(d):
    """The written workbooks, read by the operator."""
    grid = workbooks.ingest_workbooks(d.spark, write_workbooks(d))
    return grid.withColumn("file", F.element_at(F.split("file", "/"), -1))


CELLS = """
WITH n AS (SELECT s_suppkey // 200 AS book, s_name, s_suppkey, s_acctbal,
    row_number() OVER (PARTITION BY s_suppkey // 200 ORDER BY s_suppkey) AS r FROM supplier),
data AS (
    SELECT book, CAST(r AS INTEGER) AS row, 0 AS col, s_name AS value FROM n
    UNION ALL SELECT book, CAST(r AS INTEGER), 1, CAST(s_suppkey AS VARCHAR) FROM n
    UNION ALL SELECT book, CAST(r AS INTEGER), 2, CASE WHEN s_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END FROM n
    UNION ALL SELECT book, CAST(r AS INTEGER), 3, CAST(DATE '2024-01-01' + CAST(s_suppkey AS INTEGER) AS VARCHAR) FROM n
    UNION ALL SELECT DISTINCT book, 0, unnest([0, 1, 2, 3]), unnest(['Name', 'Key', 'Rich', 'Since']) FROM n),
cells AS (
    SELECT concat('book_', CAST(book AS VARCHAR), '.xlsx') AS file, 'Data' AS sheet, 0 AS sheet_no, row, col, value FROM data
    UNION ALL SELECT DISTINCT concat('book_', CAST(book AS VARCHAR), '.xlsx'), 'Notes', 1, 2, 1, concat('book ', CAST(book AS VARCHAR), ' & more') FROM n)
"""


@query("s03_ingest_workbooks", CELLS + "SELECT * FROM cells")
def s03(d):
    return supplier_workbooks(d)


@query("s03_workbook_source", CELLS + "SELECT * FROM cells WHERE sheet = 'Data'")
def s03_source(d):
    """One sheet of every workbook, by the data source; a task per sheet."""
    d.spark.dataSource.register(workbooks.WorkbookSource)
    grid = d.spark.read.format("workbook").options(sheets="Data", split=1).load(write_workbooks(d))
    return grid.withColumn("file", F.element_at(F.split("file", "/"), -1))


@query(
    "s03_sheet_list",
    CELLS + "SELECT file, sheet, sheet_no, max(row) + 1 AS rows, max(col) + 1 AS columns FROM cells GROUP BY ALL",
)
def s03_sheets(d):
    return workbooks.sheet_list(supplier_workbooks(d))


@query(
    "s04_resolve_table",
    "SELECT n_name AS name, 1 AS rank FROM nation WHERE lower(n_name) = lower((SELECT min(n_name) FROM nation WHERE n_nationkey > 0)) ORDER BY n_nationkey LIMIT 1",
)
def s04(d):
    catalog = d.table("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    wanted = catalog.where("position > 0").agg(F.min("name")).first()[0]
    return tables.resolve_table(catalog, wanted.swapcase())


@query(
    "s05_cells_to_table",
    CELLS + "SELECT file, row, max(CASE WHEN col = 0 THEN value END) AS c0, max(CASE WHEN col = 1 THEN value END) AS c1 FROM cells WHERE sheet_no = 0 GROUP BY file, row",
)
def s05(d):
    return tables.cells_to_table(supplier_workbooks(d).where("sheet_no = 0"), 2, keys=["file"])


@query("s06_write_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def s06(d):
    path = scratch_path(d.spark, "csv")
    tables.write_csv(d.table("orders").select("o_orderkey", "o_orderpriority"), path)
    return d.spark.read.csv(path, header=True)


@query(
    "s07_write_table",
    "SELECT c_custkey AS id, 'book' AS dataset, c_mktsegment AS sheet, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new' ELSE 'old' END AS version FROM customer",
)
def s07(d):
    path = scratch_path(d.spark, "sheets")
    df = d.table("customer").select(
        F.col("c_custkey").alias("id"), F.lit("book").alias("dataset"), F.col("c_mktsegment").alias("sheet")
    )
    tables.write_table(df.withColumn("version", F.lit("old")), path)
    tables.write_table(df.where("sheet = 'BUILDING'").withColumn("version", F.lit("new")), path)
    return d.spark.read.parquet(path)


@query(
    "s08_to_records_json",
    "SELECT row_id, to_json({'cust_id': cust_id, 'value_text': value_text, 'spare': spare}) AS record FROM f",
    "dirty_orders",
)
def s08(d):
    df = d.fixture("dirty_orders").select("row_id", "cust_id", "value_text", "spare")
    return tables.to_records_json(df, "row_id")


@query(
    "s08_sheet_summary",
    "SELECT c_mktsegment, count(*) AS rows, 2 AS n_columns, '[\"c_custkey\",\"c_name\"]' AS columns FROM customer GROUP BY 1",
)
def s08_summary(d):
    df = d.table("customer").select("c_mktsegment", "c_custkey", "c_name")
    return tables.sheet_summary(df, "c_mktsegment")


def _sanitized(e):
    t = rf"regexp_replace({e}, '(\.xlsx|\.xls)$', '')"
    return rf"trim(regexp_replace(regexp_replace({t}, '[^\w\-]', '_', 'g'), '_+', '_', 'g'), '_')"


@query(
    "s09_stage_path",
    f"SELECT p_partkey, concat({_sanitized('''concat(p_name, ' (v1).xlsx')''')}, '/', CASE WHEN p_partkey % 3 = 0 THEN 'default_sheet' ELSE {_sanitized('p_type')} END, "
    "'/cleaned/', CAST(p_partkey AS VARCHAR), '.xlsx') AS path FROM part",
)
def s09(d):
    df = d.table("part").select(
        "p_partkey",
        F.concat("p_name", F.lit(" (v1).xlsx")).alias("book"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END").alias("sheet"),
        F.col("p_partkey").cast("string").alias("id"),
    )
    return df.select("p_partkey", store.stage_path("book", "sheet", "cleaned", "id").alias("path"))


@query("s10_write_stage", "SELECT o_orderkey, 'cleaned' AS stage FROM orders UNION ALL SELECT o_orderkey, 'uploads' FROM orders")
def s10(d):
    root = scratch_path(d.spark, "store")
    df = d.table("orders").select("o_orderkey")
    store.write_stage(df, root, "Book 1.xlsx", "Sheet 1", "uploads", "a1")
    store.write_stage(df, root, "Book 1.xlsx", "Sheet 1", "cleaned", "a1")
    return d.spark.read.parquet(f"{root}/tables").select("o_orderkey", "stage")


@query("s11_read_stage", "SELECT o_orderkey, o_totalprice FROM orders")
def s11(d):
    """Tables of other columns, ids with leading zeros and raw names in one store."""
    root = scratch_path(d.spark, "store")
    df = d.table("orders").select("o_orderkey", "o_totalprice")
    store.write_stage(df, root, "Book 1.xlsx", "", "uploads", "001")
    store.write_stage(d.table("part").select("p_partkey", "p_name"), root, "Book 1.xlsx", "", "uploads", "1")
    store.write_stage(df.withColumn("o_totalprice", F.lit(0.0)), root, "Book 1.xlsx", "", "cleaned", "001")
    return store.read_stage(d.spark, root, "Book 1.xlsx", "", "uploads", "001")


@query("s11_read_stage_other_columns", "SELECT p_partkey, p_name FROM part")
def s11_other(d):
    root = scratch_path(d.spark, "store")
    store.write_stage(d.table("orders").select("o_orderkey"), root, "Book 1.xlsx", "S 1", "uploads", "001")
    store.write_stage(d.table("part").select("p_partkey", "p_name"), root, "Book 1.xlsx", "S 1", "uploads", "1")
    return store.read_stage(d.spark, root, "Book_1", "S_1", "uploads", "1")


@query(
    "s11_read_stage_mixed",
    "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_totalprice AS price, NULL AS name FROM orders UNION ALL SELECT concat('p', CAST(p_partkey AS VARCHAR)), NULL, p_name FROM part",
)
def s11_mixed(d):
    """A whole stage: a column that is a number in one table and text in another."""
    root = scratch_path(d.spark, "store")
    orders = d.table("orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    parts = d.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("name"))
    store.write_stage(orders, root, "Book", "S", "uploads", "1")
    store.write_stage(parts, root, "Book", "S", "uploads", "2")
    return store.read_stage(d.spark, root, "Book", "S", "uploads")


@query(
    "s12_merged_sketches",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, true AS distinct_close, {q} AS median_close FROM orders"
        for c, q in (("o_orderkey", "true"), ("o_custkey", "true"), ("o_totalprice", "true"), ("o_orderpriority", "NULL"))
    ),
)
def s12_sketches(d):
    """Statistics of a folder from the sketches of its parts, against whole-table ones: 4 %
    of the distinct values, 1 % of the ranks."""
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    orders, root = d.table("orders").select(*columns), scratch_path(d.spark, "store")
    for part in range(4):
        sketches.write_sketches(orders.where(F.col("o_orderkey") % 4 == part), root, "Book", "S", "1", str(part))
    found = sketches.merged(sketches.read_sketches(d.spark, root), probs=[0.49, 0.51])
    whole = profile.unique_count(orders).join(profile.describe(orders).select("column", "q50"), "column", "left")
    close = F.abs(F.col("distinct") - F.col("unique_count")) <= 0.04 * F.col("unique_count")
    median = F.col("q50").between(F.col("quantiles")[0], F.col("quantiles")[1])
    return found.join(whole, "column").select("column", "rows", "non_null", close.alias("distinct_close"), median.alias("median_close"))


@query("s12_metadata", "SELECT 'Book' AS dataset, 'S' AS sheet, 'a1' AS id, count(*) AS rows, true AS stamped FROM orders")
def s12(d):
    root = scratch_path(d.spark, "store")
    df = d.table("orders").select("o_orderkey")
    body = lambda n: n.select(F.to_json(F.struct("rows")).alias("body"))
    store.write_metadata(body(df.agg((F.count("*") - 1).alias("rows"))), root, "Book", "S", "a1")
    store.write_metadata(body(df.agg(F.count("*").alias("rows"))), root, "Book", "S", "a1")
    store.write_stage(df, root, "Book.xls", "S", "cleaned", "a1")
    out = store.read_metadata(d.spark, root)
    return out.select(
        "dataset", "sheet", "id",
        F.get_json_object("body", "$.rows").cast("long").alias("rows"),
        F.col("last_cleaned").isNotNull().alias("stamped"),
    )


PARTS = "split_part(path, '/', 1) AS dataset, split_part(path, '/', 2) AS sheet, split_part(path, '/', 3) AS stage, regexp_replace(split_part(path, '/', 4), '\\.[^.]*$', '') AS id"


@query(
    "s13_list_datasets",
    f"SELECT DISTINCT id, dataset, sheet, concat(dataset, '/', sheet) AS path FROM (SELECT {PARTS} FROM f WHERE path LIKE '%.json') WHERE stage = 'metadata'",
    "stored_objects",
)
def s13(d):
    return store.list_datasets(d.fixture("stored_objects"))


@query(
    "s14_dataset_info",
    f"SELECT id, dataset, sheet, bool_or(stage = 'uploads') AS original_file_exists, bool_or(stage = 'cleaned') AS cleaned_file_exists, "
    "bool_or(stage = 'metadata') AS metadata_exists, CAST(sum(length) FILTER (WHERE stage = 'uploads') AS BIGINT) AS original_file_size, "
    f"CAST(sum(length) FILTER (WHERE stage = 'cleaned') AS BIGINT) AS cleaned_file_size FROM (SELECT *, {PARTS} FROM f) GROUP BY id, dataset, sheet",
    "stored_objects",
)
def s14(d):
    return store.dataset_info(d.fixture("stored_objects"))


@query("s14_object_listing", "SELECT DISTINCT concat('c_mktsegment=', c_mktsegment) AS folder, true AS has_bytes FROM customer")
def s14_listing(d):
    root = scratch_path(d.spark, "objects")
    d.table("customer").write.partitionBy("c_mktsegment").json(root)
    listed = store.object_listing(d.spark, root, 2).where("path LIKE 'c_mktsegment=%'")
    return listed.groupBy(F.split("path", "/")[0].alias("folder")).agg((F.sum("length") > 0).alias("has_bytes"))


@query(
    "s15_upload_record",
    "SELECT c_mktsegment AS filename, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), '|' ORDER BY CAST(c_nationkey AS VARCHAR)) AS sheets, "
    "CAST(count(DISTINCT c_nationkey) AS INTEGER) AS n_sheets, true AS has_id FROM customer GROUP BY 1",
)
def s15(d):
    df = d.table("customer").withColumn("sheet", F.col("c_nationkey").cast("string"))
    return store.upload_records(df, "c_mktsegment", "sheet").select(
        "filename", F.array_join("sheets", "|").alias("sheets"), "n_sheets", F.col("id").isNotNull().alias("has_id")
    )


