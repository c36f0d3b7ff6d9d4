"""Queries of the row, column and header operators (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwash.functions import cells, rules
from gridwash.operators import structure
from registry import sqltext as s
from registry.base import DATA_COLUMNS, query

SHEET = DATA_COLUMNS["raw_sheet"]
ROW = "row_id"
BLANK = " AND ".join(f"coalesce({s.trim(c)}, '') = ''" for c in SHEET)


@query("p01_drop_empty_rows", f"SELECT * FROM f WHERE NOT ({BLANK})", "raw_sheet")
def p01(d):
    return structure.drop_empty_rows(d.fixture("raw_sheet"), ROW)


@query("p02_drop_null_rows", "SELECT event_id, value FROM f WHERE value IS NOT NULL", "dup_events")
def p02(d):
    return structure.drop_null_rows(d.fixture("dup_events").select("event_id", "value"), "event_id")


@query("p03_drop_empty_columns", f"SELECT row_id, c0, c1, c2, c4 FROM f WHERE NOT ({BLANK})", "raw_sheet")
def p03(d):
    return structure.drop_empty_columns(
        structure.drop_empty_rows(d.fixture("raw_sheet"), ROW), ROW
    )


@query("p04_drop_null_columns", "SELECT * EXCLUDE (spare) FROM f", "dirty_orders")
def p04(d):
    return structure.drop_null_columns(d.fixture("dirty_orders"), ROW)


HEADERS = """SELECT p_size AS sheet, CASE WHEN p_partkey % 5 = 0 THEN concat('Column_', CAST(p_partkey AS STRING))
    WHEN p_partkey % 7 = 0 THEN CAST(p_retailprice AS STRING) WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END AS name FROM {part}"""
# RE2 knows no escape for the currency signs.
SYMBOLS = rules.SYMBOLS_ONLY.replace(r"\€", "€").replace(r"\£", "£")
GENERIC = " OR ".join(s.has("t", p) for p in rules.GENERIC_HEADERS)
DATA_LIKE = (
    f"t != '' AND ({s.number('t')} OR {s.date_like('t')} OR length(t) > 50 OR {s.has('t', SYMBOLS)})"
)


@query(
    "p05_headers_are_good",
    f"WITH h AS (SELECT sheet, coalesce({s.trim('name')}, '') AS t FROM ({HEADERS})), r AS (SELECT sheet, count(*) AS columns, "
    f"count(*) FILTER (WHERE {GENERIC}) / count(*) AS generic_ratio, count(*) FILTER (WHERE {DATA_LIKE}) / count(*) AS data_like_ratio "
    "FROM h GROUP BY sheet) SELECT *, generic_ratio < 0.5 AND data_like_ratio < 0.3 AS good FROM r",
)
def p05(d):
    return structure.header_quality_of(d.sql(HEADERS), "sheet", "name")


@query(
    "p06_looks_like_data",
    f"SELECT row_id, coalesce({DATA_LIKE.replace('t ', 'order_date ', 1)}, false) AS order_date, 1 AS one FROM f".replace(
        DATA_LIKE.replace("t ", "order_date ", 1),
        f"(SELECT {DATA_LIKE} FROM (SELECT {s.trim('order_date')} AS t))",
    ).replace(", 1 AS one", f", coalesce((SELECT {DATA_LIKE} FROM (SELECT {s.trim('priority')} AS t)), false) AS priority"),
    "dirty_orders",
)
def p06(d):
    df = d.fixture("dirty_orders")
    return df.select(
        "row_id",
        cells.looks_like_data("order_date").alias("order_date"),
        cells.looks_like_data("priority").alias("priority"),
    )


PROMOTED = 'SELECT row_id, c0 AS "Name", c1 AS "Key", c2 AS "Key_1", c3 AS "Column_4", c4 AS "Column_5" FROM f WHERE row_id > 1'


@query("p07_promote_first_row", PROMOTED, "raw_sheet")
def p07(d):
    return structure.promote_first_row(
        structure.drop_empty_rows(d.fixture("raw_sheet"), ROW), ROW
    )


@query("p08_promote_header_row", PROMOTED, "raw_sheet")
def p08(d):
    return structure.promote_header_row(d.fixture("raw_sheet"), ROW, 1)


@query(
    "p09_generate_names",
    "SELECT row_id, " + ", ".join(f'{c} AS "Column_{i}"' for i, c in enumerate(SHEET, 1)) + " FROM f",
    "raw_sheet",
)
def p09(d):
    return structure.generate_names(d.fixture("raw_sheet"), ROW)


TAG = (
    f"CASE WHEN coalesce({s.trim('value')}, '') = '' THEN NULL WHEN {s.has('value', '[/-]')} AND {s.has('value', '[0-9]')} THEN 'date-like' "
    f"WHEN {s.has(chr(116) + 'ranslate(value, ' + chr(39) + '.,-' + chr(39) + ', ' + chr(39) * 2 + ')', '^[0-9]+$')} THEN 'numeric-string' ELSE 'text' END"
)


@query(
    "p10_detect_header_row",
    f"""
    WITH head AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS row_no FROM f ORDER BY row_id LIMIT 20),
    tags AS (SELECT row_no, "column", tag FROM (SELECT row_no, "column", {TAG} AS tag FROM (
        {' UNION ALL '.join(f"SELECT row_no, '{c}' AS column, {c} AS value FROM head" for c in SHEET)})) WHERE tag IS NOT NULL),
    below AS (SELECT a.row_no, a."column", b.tag, count(*) AS n FROM tags a JOIN tags b ON a."column" = b."column" AND b.row_no > a.row_no GROUP BY ALL),
    major AS (SELECT row_no, "column", arg_max(tag, (n, tag)) AS tag FROM below GROUP BY ALL),
    differs AS (SELECT row_no FROM major GROUP BY row_no HAVING bool_or(tag != 'text')),
    texts AS (SELECT row_no FROM tags GROUP BY row_no HAVING bool_and(tag = 'text'))
    SELECT CAST(coalesce(min(row_no), 0) AS INTEGER) AS header_row FROM texts SEMI JOIN differs USING (row_no)
    """,
    "raw_sheet",
)
def p10(d):
    df = d.fixture("raw_sheet")
    k = structure.detect_header_row(df, ROW)
    return df.agg(F.first(F.lit(k)).cast("int").alias("header_row"))


@query(
    "p10_row_type_tags",
    f"SELECT CAST(row_no AS INTEGER) AS row_no, \"column\", tag FROM (SELECT row_no, \"column\", {TAG} AS tag FROM ("
    + " UNION ALL ".join(
        f"SELECT row_no, '{c}' AS \"column\", {c} AS value FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS row_no FROM f ORDER BY row_id LIMIT 20)"
        for c in SHEET
    )
    + ")) WHERE tag IS NOT NULL",
    "raw_sheet",
)
def p10_tags(d):
    return structure.row_type_tags(d.fixture("raw_sheet"), ROW)


@query(
    "p11_clean_column_names",
    'SELECT s_suppkey AS row_id, s_name AS "Supplier_Name", s_acctbal AS "Supplier_Name_1", s_nationkey AS "a_b" FROM supplier',
)
def p11(d):
    df = d.table("supplier").select(
        F.col("s_suppkey").alias("row_id"),
        F.col("s_name").alias("Supplier/Name"),
        F.col("s_acctbal").alias("Supplier__Name "),
        F.col("s_nationkey").alias("_a\n\tb_"),
    )
    return structure.clean_column_names(df, ROW)


@query(
    "p12_snake_case_names",
    "SELECT s_suppkey AS row_id, s_name AS supplier_name, s_acctbal AS account_balance FROM supplier",
)
def p12(d):
    df = d.table("supplier").select(
        F.col("s_suppkey").alias("row_id"),
        F.col("s_name").alias("Supplier Name"),
        F.col("s_acctbal").alias(" Account Balance"),
    )
    return structure.snake_case_names(df, ROW)


@query("p13_apply_headers", "SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation")
def p13(d):
    df = d.table("nation").select("n_nationkey", "n_name", "n_regionkey")
    return structure.apply_headers(structure.apply_headers(df, ["k", "v", "r"]), ["too", "short"])


@query(
    "p14_name_generic_columns",
    "SELECT row_id, email AS email, ifsc AS ifsc_code, pincode AS pincode, amount AS currency_inr FROM f",
    "contacts",
)
def p14(d):
    df = d.fixture("contacts").select(
        "row_id",
        F.col("email").alias("Column_1"),
        F.col("ifsc").alias("Column_2"),
        F.col("pincode").alias("Unnamed_3"),
        F.col("amount").alias("Column_4"),
    )
    return structure.name_generic_columns(df, ROW)


@query("p15_rename", "SELECT r_regionkey AS id, r_name AS region FROM region")
def p15(d):
    return structure.rename(d.table("region"), {"r_regionkey": "id", "r_name": "region"}).select(
        "id", "region"
    )


@query("p16_preserve_shape", "SELECT o_orderkey, o_custkey FROM orders")
def p16(d):
    df = d.table("orders").select("o_orderkey", "o_custkey")
    shorter = df.where("o_orderkey % 2 = 0")
    return structure.preserve_shape(df, shorter)


@query(
    "p17_header_pipeline",
    'SELECT row_id, c0 AS "Name", c1 AS "Key", c2 AS "Key_1", c4 AS "Column_4" FROM f WHERE row_id > 1',
    "raw_sheet",
)
def p17(d):
    # Numbered labels, as a headerless read gives them.
    df = d.fixture("raw_sheet").toDF(ROW, "0", "1", "2", "3", "4")
    return structure.header_pipeline(df, ROW)[1]


@query("p18_preview", "SELECT * FROM f ORDER BY row_id LIMIT 50", "dirty_orders")
def p18(d):
    return structure.preview(d.fixture("dirty_orders"), ROW, 50)


@query(
    "p19_header_comparison",
    "SELECT CAST(n_nationkey AS INTEGER) AS position, n_name AS current, lower(n_name) AS proposed FROM nation",
)
def p19(d):
    names = [r[0] for r in d.table("nation").orderBy("n_nationkey").select("n_name").collect()]
    return structure.header_comparison(d.spark, names, [n.lower() for n in names])


@query(
    "p16_observed_rows",
    "SELECT count(*) AS rows FROM orders",
)
def p16_observed(d):
    df, watch = structure.observed_rows(d.table("orders").select("o_orderkey"))
    df.write.format("noop").mode("overwrite").save()
    return d.table("orders").agg(F.first(F.lit(watch.get["rows"])).alias("rows"))


