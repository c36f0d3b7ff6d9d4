"""Queries of the cleaning catalogue (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwash.functions import cells, formats
from gridwash.operators import convert, structure, validation
from gridwash.operators.catalogue import (
    checks,
    consistency,
    dates,
    duplicates,
    gaps,
    numbers,
    structural,
    text,
)
from registry import sqltext as s
from registry.base import DATA_COLUMNS, query
from registry.profile import _bounds
from registry.structure import BLANK
from registry.validation import _flags

ROW = "row_id"
SHEET = DATA_COLUMNS["raw_sheet"]


@query("k01_remove_empty", f"SELECT row_id, c0, c1, c2, c4 FROM f WHERE NOT ({BLANK})", "raw_sheet")
def k01(d):
    return structural.remove_empty(d.fixture("raw_sheet"), ROW)


# Every nation is a sheet of supplier cells; each tenth row's range of 3 x 2 cells is merged.
GRID = """SELECT CAST(s_nationkey AS STRING) AS sheet, CAST(s_suppkey AS INT) AS row, CAST(c AS INT) AS col,
    CASE WHEN c = 0 THEN s_name WHEN c = 1 THEN CAST(s_suppkey AS STRING) END AS value
    FROM {supplier}, (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) t"""
RANGES = """SELECT CAST(s_nationkey AS STRING) AS sheet, CAST(s_suppkey AS INT) AS min_row, CAST(s_suppkey AS INT) + 2 AS max_row,
    0 AS min_col, 1 AS max_col FROM {supplier} WHERE s_suppkey % 10 = 0"""


@query(
    "k02_fill_merged_cells",
    f"""
    WITH g AS ({GRID}), r AS ({RANGES}),
    cov AS (SELECT r.sheet, r.min_row, t.row, u.col FROM r, LATERAL (SELECT unnest(generate_series(r.min_row, r.max_row)) AS row) t,
            (SELECT 0 AS col UNION ALL SELECT 1) u),
    m AS (SELECT cov.sheet, cov.row, cov.col, g.value AS corner FROM cov LEFT JOIN g ON g.sheet = cov.sheet AND g.row = cov.min_row AND g.col = 0)
    SELECT coalesce(g.sheet, m.sheet) AS sheet, CAST(coalesce(g.row, m.row) AS INTEGER) AS row, CAST(coalesce(g.col, m.col) AS INTEGER) AS col,
        CASE WHEN m.sheet IS NOT NULL THEN m.corner ELSE g.value END AS value
    FROM g FULL JOIN m ON g.sheet = m.sheet AND g.row = m.row AND g.col = m.col
    """,
)
def k02(d):
    return structural.fill_merged_cells(d.sql(GRID), d.sql(RANGES))


@query(
    "k03_merge_header_rows",
    'SELECT row_id, c0 AS "Name", c1 AS "Key", c2 AS "Key_1", c3 AS "Column_4", c4 AS "Column_5" FROM f WHERE row_id > 1',
    "raw_sheet",
)
def k03(d):
    return structural.merge_header_rows(d.fixture("raw_sheet"), ROW, 2)


@query("k04_standardize_column_names", "SELECT s_suppkey AS row_id, s_name AS supplier_name FROM supplier")
def k04(d):
    df = d.table("supplier").select(F.col("s_suppkey").alias(ROW), F.col("s_name").alias(" Supplier/Name "))
    return structure.snake_case_names(structure.clean_column_names(df, ROW), ROW)


SHEETS = """SELECT concat('A', CAST(c_nationkey AS STRING)) AS sheet, c_custkey, c_name FROM {customer}
    UNION ALL SELECT concat('B', CAST(c_nationkey AS STRING)), c_custkey, c_name FROM {customer} WHERE c_nationkey % 5 = 0
    UNION ALL SELECT concat('C', CAST(c_nationkey AS STRING)), c_custkey + 1, c_name FROM {customer} WHERE c_nationkey % 7 = 0"""


@query(
    "k05_duplicate_sheets",
    f"WITH b AS (SELECT sheet, string_agg(concat(c_custkey, c_name), '|' ORDER BY c_custkey) AS body FROM ({SHEETS}) GROUP BY sheet) "
    "SELECT sheet, first_sheet AS duplicate_of FROM (SELECT *, min(sheet) OVER (PARTITION BY body) AS first_sheet FROM b) WHERE sheet != first_sheet",
)
def k05(d):
    return structural.duplicate_sheets(d.sql(SHEETS), "sheet")


@query(
    "k05_remove_duplicate_sheets",
    f"SELECT sheet, count(*) AS rows FROM ({SHEETS}) WHERE sheet NOT LIKE 'B%' GROUP BY sheet",
)
def k05_remove(d):
    out = structural.remove_duplicate_sheets(d.sql(SHEETS), "sheet")
    return out.groupBy("sheet").agg(F.count("*").alias("rows"))


@query(
    "k06_split_column",
    "SELECT p_partkey, p_type, split_part(p_type, ' ', 1) AS grade, NULLIF(split_part(p_type, ' ', 2), '') AS finish FROM part",
)
def k06(d):
    return structural.split_column(d.table("part").select("p_partkey", "p_type"), "p_type", " ", ["grade", "finish"])


@query(
    "k06_explode_column",
    "SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS part_no, string_split(o_orderpriority, '-')[i] AS o_orderpriority FROM orders, "
    "LATERAL (SELECT unnest(generate_series(1, len(string_split(o_orderpriority, '-')))) AS i) t",
)
def k06_explode(d):
    return structural.explode_column(d.table("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-")


@query("k07_sort_columns", "SELECT r_regionkey, r_name FROM region")
def k07(d):
    return structural.sort_columns(d.table("region"), "r_regionkey")


@query("k08_trim_whitespace", f"SELECT row_id, {s.trim('priority')} AS priority FROM f", "dirty_orders")
def k08(d):
    return convert.trim_all(d.fixture("dirty_orders").select(ROW, "priority"), ROW)


@query("k09_remove_special", r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g') AS text FROM documents")
def k09(d):
    return d.table("documents").select("doc_id", text.remove_special("text").alias("text"))


@query("k10_fix_encoding", "SELECT doc_id, text FROM documents WHERE true")
def k10(d):
    """Every second text is garbled first; the repair gives all texts back."""
    garbled = F.when(
        F.col("doc_id") % 2 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    ).otherwise(F.col("text"))
    return d.table("documents").select("doc_id", garbled.alias("text")).select(
        "doc_id", text.fix_encoding("text").alias("text")
    )


@query("k11_standardize_case", "SELECT o_orderkey, upper(o_orderpriority) AS o_orderpriority, lower(o_orderstatus) AS o_orderstatus FROM orders")
def k11(d):
    return d.table("orders").select(
        "o_orderkey",
        cells.case_text("o_orderpriority", "upper").alias("o_orderpriority"),
        cells.case_text("o_orderstatus", "lower").alias("o_orderstatus"),
    )


@query(
    "k12_normalize_name",
    "SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1:1]), lower(w[2:]))), 'string_agg', ' ') AS p_name FROM part",
)
def k12(d):
    messy = F.concat(F.lit("  "), F.upper(F.regexp_replace("p_name", " ", "   ")), F.lit("\t"))
    return d.table("part").select("p_partkey", text.normalize_name(messy).alias("p_name"))


@query("k13_remove_control", r"SELECT page_id, regexp_replace(html, '[\x00-\x1F\x7F]', '', 'g') AS html FROM pages")
def k13(d):
    return d.table("pages").select("page_id", text.remove_control("html").alias("html"))


@query(
    "k14_split_words",
    "SELECT event_id, concat(event_type, ' Type ', CAST(user_id AS VARCHAR)) AS words FROM events",
)
def k14(d):
    joined = F.concat("event_type", F.lit("Type"), F.col("user_id").cast("string"))
    return d.table("events").select("event_id", text.split_words(joined).alias("words"))


@query(
    "k15_mixed_scripts",
    r"SELECT doc_id, length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) AS latin, length(regexp_replace(text, '[^\p{Cyrillic}]', '', 'g')) AS cyrillic, "
    r"length(regexp_replace(text, '[^\p{Han}]', '', 'g')) AS han FROM documents",
)
def k15(d):
    counts = text.script_counts("text")
    return d.table("documents").select(
        "doc_id", *[counts[n].alias(n.lower()) for n in ("Latin", "Cyrillic", "Han")]
    )


SCRIPT_NAMES = ("Latin", "Cyrillic", "Han")
LETTERS = {n: rf"length(regexp_replace(text, '[^\p{{{n}}}]', '', 'g'))" for n in SCRIPT_NAMES}
LETTER_SUM = "(" + " + ".join(LETTERS.values()) + ")"


@query(
    "k15_flag_mixed_script",
    "SELECT doc_id, ("
    + " + ".join(f"CAST({e} > {LETTER_SUM} * 0.1 AS INTEGER)" for e in LETTERS.values())
    + ") > 1 AS mixed_script FROM documents",
)
def k15_flag(d):
    df = d.table("documents").select("doc_id", "text")
    return text.flag_mixed_script(df, "text", scripts=SCRIPT_NAMES).drop("text")


@query("k16_text_to_numbers", "SELECT row_id, CAST(value_text AS DOUBLE) AS value_text, priority FROM f", "dirty_orders")
def k16(d):
    return convert.to_numeric_safe(d.fixture("dirty_orders").select(ROW, "value_text", "priority"), ROW)


SIGNED = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('(', CAST(c_custkey AS STRING), ')') WHEN c_custkey % 3 = 1 THEN concat(CAST(c_custkey AS STRING), '-') ELSE c_name END AS v FROM {customer}"


@query(
    "k17_fix_negative",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 < 2 THEN concat('-', CAST(c_custkey AS VARCHAR)) ELSE c_name END AS v FROM customer",
)
def k17(d):
    return d.sql(SIGNED).select("id", numbers.fix_negative("v").alias("v"))


@query(
    "k18_standard_separators",
    "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM orders",
)
def k18(d):
    plain = F.col("o_totalprice").cast("decimal(18,2)")
    us = F.format_number(plain, 2)
    eu = F.translate(us, ",.", ".,")
    return d.table("orders").select(
        "o_orderkey",
        numbers.standard_separators(F.when(F.col("o_orderkey") % 2 == 0, us).otherwise(eu)).alias("price"),
    )


@query("k19_round_all", "SELECT row_id, round(qty, 1) AS qty, round(discount, 1) AS discount FROM f", "outlier_lines")
def k19(d):
    return numbers.round_all(d.fixture("outlier_lines"), 1, order_by=ROW)


@query("k20_normalize_currency", f"SELECT row_id, {s.standard('amount', 'currency_inr')} AS amount FROM f", "contacts")
def k20(d):
    return d.fixture("contacts").select(ROW, formats.standardize_value("amount", "currency_inr").alias("amount"))


@query(
    "k21_winsorize",
    f"WITH b AS ({_bounds(['value'], 1.5, 'events')}) SELECT event_id, round(greatest(low, least(high, value)), 6) AS value FROM events, b",
)
def k21(d):
    out = numbers.winsorize(d.table("events").select("event_id", "value"), order_by="event_id")
    return out.withColumn("value", F.round("value", 6))


LINE = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_orderkey % 8 = 0 THEN l_extendedprice + 5 ELSE l_extendedprice * (1 - l_discount) END AS net, l_discount FROM {lineitem}"
NET = "l_extendedprice * (1 - l_discount)"


@query(
    "k22_fix_calculation",
    f"SELECT l_orderkey, l_linenumber, round({NET}, 4) AS net FROM lineitem",
)
def k22(d):
    out = numbers.fix_calculation(d.sql(LINE), "net", NET, 0.02)
    return out.select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"))


UNITS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN concat(CAST(p_size AS STRING), ' kg') WHEN p_partkey % 4 = 1 THEN concat(CAST(p_size AS STRING), 'G') WHEN p_partkey % 4 = 2 THEN concat(CAST(p_size AS STRING), '.5 lb') ELSE 'n/a' END AS weight FROM {part}"
FACTORS = [("kg", "g", 1000.0), ("g", "g", 1.0), ("lb", "g", 453.59237)]


@query(
    "k23_normalize_units",
    "SELECT p_partkey AS id, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 1.0 WHEN 2 THEN (p_size + 0.5) * 453.59237 END, 4)::DOUBLE AS weight__value, "
    "CASE WHEN p_partkey % 4 < 3 THEN 'g' END AS weight__unit FROM part",
)
def k23(d):
    factors = d.spark.createDataFrame(FACTORS, "unit string, base_unit string, factor double")
    out = numbers.normalize_units(d.sql(UNITS), "weight", factors)
    return out.select("id", F.round("weight__value", 4).alias("weight__value"), "weight__unit")


@query(
    "k44_standardize_units",
    "SELECT o_orderkey AS id, round(o_custkey * 1000.0, 4)::DOUBLE AS qty__value, 'g' AS qty__unit FROM orders",
)
def k44(d):
    factors = d.spark.createDataFrame(FACTORS, "unit string, base_unit string, factor double")
    df = d.table("orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.col("o_custkey").cast("string"), F.lit(" KG")).alias("qty")
    )
    return numbers.normalize_units(df, "qty", factors).select("id", "qty__value", "qty__unit")


@query(
    "k24_text_to_datetime",
    f"SELECT row_id, strftime({s.date_value('order_date', day_first=False)}, '%Y-%m-%d') AS order_date FROM f",
    "dirty_orders",
)
def k24(d):
    out = convert.to_datetime_safe(d.fixture("dirty_orders").select(ROW, "order_date"), ROW)
    return out.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query(
    "k25_standardize_dates_null",
    f"SELECT row_id, strftime({s.date_value('order_date')}, '%Y/%m/%d') AS order_date FROM f",
    "dirty_orders",
)
def k25(d):
    return convert.standardize_dates(
        d.fixture("dirty_orders").select(ROW, "order_date"), ROW, on_unparsed="null"
    )


@query(
    "k26_null_invalid_dates",
    f"SELECT row_id, CASE WHEN {s.date_value('order_date')} IS NOT NULL THEN order_date END AS order_date FROM f",
    "dirty_orders",
)
def k26(d):
    return dates.null_invalid_dates(d.fixture("dirty_orders").select(ROW, "order_date"), "order_date")


@query(
    "k27_fill_missing_dates",
    "WITH per AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL), "
    "cal AS (SELECT o_orderpriority, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM per GROUP BY 1) "
    "SELECT cal.o_orderpriority, strftime(cal.day, '%Y-%m-%d') AS day, n FROM cal LEFT JOIN per ON cal.o_orderpriority = per.o_orderpriority AND cal.day = per.day",
)
def k27(d):
    per = (
        d.table("orders")
        .groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day"))
        .agg(F.count("*").alias("n"))
    )
    out = dates.fill_missing_dates(per, "o_orderpriority", "day")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "k27_missing_date_ranges",
    "WITH days AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), "
    "n AS (SELECT *, lead(day) OVER (PARTITION BY o_custkey ORDER BY day) AS following FROM days) "
    "SELECT o_custkey, strftime(day + INTERVAL 1 DAY, '%Y-%m-%d') AS missing_from, strftime(following - INTERVAL 1 DAY, '%Y-%m-%d') AS missing_to, "
    "CAST(date_diff('day', day, following) - 1 AS INTEGER) AS days FROM n WHERE date_diff('day', day, following) > 1",
)
def k27_ranges(d):
    out = dates.missing_date_ranges(d.table("orders").select("o_custkey", "o_orderdate"), "o_custkey", "o_orderdate")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("missing_from", "missing_to")})


@query(
    "k28_date_parts",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate__year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate__month, "
    "CAST(day(o_orderdate) AS INTEGER) AS o_orderdate__day, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate__quarter, "
    "CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS o_orderdate__weekday FROM orders",
)
def k28(d):
    return dates.date_parts(d.table("orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "k29_convert_zone",
    "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS local FROM events",
)
def k29(d):
    local = dates.convert_zone("ts", "UTC", "Asia/Kolkata")
    return d.table("events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local"))


@query(
    "k30_split_datetime",
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts__date, strftime(ts, '%H:%M:%S') AS ts__time FROM events",
)
def k30(d):
    out = dates.split_datetime(d.table("events").select("event_id", "ts"), "ts").drop("ts")
    return out.withColumn("ts__date", F.date_format("ts__date", "yyyy-MM-dd"))


SPANS = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE event_id END AS a, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN event_id ELSE user_id END AS b FROM {events}"


@query("k31_fix_ranges", f"SELECT event_id, CASE WHEN b IS NULL THEN a ELSE least(a, b) END AS a, CASE WHEN b IS NULL THEN b ELSE greatest(a, b) END AS b FROM ({SPANS})")
def k31(d):
    return dates.fix_date_ranges(d.sql(SPANS), "a", "b")


DUP_ORDERED = "SELECT e.*, event_id * 2 AS ord FROM {events} e UNION ALL SELECT e.*, event_id * 2 + 1 FROM {events} e WHERE event_id % 10 = 0"


@query("k32_drop_exact_duplicates", "SELECT event_id, user_id, event_type, value, event_id * 2 AS ord FROM events")
def k32(d):
    df = d.sql(DUP_ORDERED).select("event_id", "user_id", "event_type", "value", "ord")
    return duplicates.drop_exact_duplicates(df, "ord")


@query(
    "k33_partial_duplicates",
    "SELECT * FROM f WHERE (user_id, event_type) IN (SELECT (user_id, event_type) FROM f GROUP BY user_id, event_type HAVING count(*) > 1)",
    "dup_events",
)
def k33(d):
    return duplicates.partial_duplicates(d.fixture("dup_events"), ["user_id", "event_type"])


@query(
    "k34_deduplicate",
    "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1",
)
def k34(d):
    df = d.table("events").select("event_id", "user_id", "event_type", "value")
    return duplicates.deduplicate(df, ["user_id", "event_type"], [F.col("value").desc(), "event_id"]).drop("value")


PLAIN = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"
KEY = f"list_aggregate(list_sort(list_distinct(string_split({PLAIN}, ' '))), 'string_agg', ' ')"


@query(
    "k35_near_duplicates",
    f"WITH k AS (SELECT doc_id, {KEY} AS key FROM documents) SELECT doc_id, near_duplicate_of, group_size FROM "
    "(SELECT doc_id, min(doc_id) OVER w AS near_duplicate_of, count(*) OVER w AS group_size FROM k WINDOW w AS (PARTITION BY key)) WHERE group_size > 1",
)
def k35(d):
    return duplicates.near_duplicates(d.table("documents"), "doc_id", "text")


@query(
    "k35_near_duplicates_minhash",
    rf"""WITH t AS (SELECT doc_id, string_split({PLAIN}, ' ') AS w FROM documents WHERE {PLAIN} <> ''),
    s AS (SELECT doc_id, unnest(list_distinct([w[i:i + 2] FOR i IN range(1, greatest(len(w) - 2, 1) + 1)])) AS shingle FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND b.doc_id < a.doc_id GROUP BY ALL),
    j AS (SELECT p.doc_id, other, c / (x.n + y.n - c) AS similarity FROM p JOIN n x ON x.doc_id = p.doc_id JOIN n y ON y.doc_id = other)
    SELECT doc_id, min(other) AS near_duplicate_of, arg_min(similarity, other) AS similarity FROM j WHERE similarity >= 0.8 GROUP BY doc_id""",
)
def k35_minhash(d):
    return duplicates.similar_texts(d.table("documents"), "doc_id", "text")


@query(
    "k36_merge_duplicates",
    "SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS value, count(*) AS merged_rows FROM f GROUP BY user_id",
    "dup_events",
)
def k36(d):
    return duplicates.merge_duplicates(d.fixture("dup_events"), "user_id", "event_id")


@query(
    "k37_flag_suspicious",
    f"SELECT row_id, priority, count(*) OVER (PARTITION BY lower({s.trim('priority')}), row_id // 20) > 1 AS suspicious FROM f",
    "dirty_orders",
)
def k37(d):
    df = d.fixture("dirty_orders").select(ROW, "priority", F.expr("row_id div 20").alias("block"))
    return duplicates.flag_suspicious(df, ["priority", "block"]).drop("block")


@query(
    "k38_missing_patterns",
    "SELECT concat("
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in DATA_COLUMNS["dirty_orders"])
    + ") AS pattern, count(*) AS rows FROM f GROUP BY 1",
    "dirty_orders",
)
def k38(d):
    return gaps.missing_patterns(d.fixture("dirty_orders"), ROW)


for _stat, _sql in (
    ("mean", "(SELECT avg(value) FROM f)"),
    ("median", "(SELECT quantile_cont(value, 0.5) FROM f)"),
    ("mode", "(SELECT v FROM (SELECT value AS v, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"),
):

    @query(f"k39_fill_{_stat}", f"SELECT event_id, round(coalesce(value, {_sql}), 6) AS value FROM f", "dup_events")
    def k39(d, stat=_stat):
        out = gaps.fill_with_statistic(d.fixture("dup_events").select("event_id", "value"), stat, ["value"])
        return out.withColumn("value", F.round("value", 6))


FILL = "SELECT event_id, event_type, CASE WHEN event_id % 7 IN (0, 1, 2) THEN NULL ELSE value END AS value FROM {events}"
FILL_KEYS = "PARTITION BY event_type ORDER BY event_id"


@query(
    "k40_forward_fill",
    f"SELECT event_id, event_type, last_value(value IGNORE NULLS) OVER ({FILL_KEYS}) AS value FROM ({FILL})",
)
def k40(d):
    return gaps.forward_fill(d.sql(FILL), "event_type", "event_id", "value")


@query(
    "k40_forward_fill_chunked",
    f"SELECT event_id, event_type, last_value(value IGNORE NULLS) OVER ({FILL_KEYS}) AS value FROM ({FILL})",
)
def k40_chunked(d):
    return gaps.forward_fill(d.sql(FILL), "event_type", "event_id", "value", group_limit=100)


@query(
    "k40_backward_fill",
    f"SELECT event_id, event_type, first_value(value IGNORE NULLS) OVER ({FILL_KEYS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM ({FILL})",
)
def k40_back(d):
    return gaps.backward_fill(d.sql(FILL), "event_type", "event_id", "value", group_limit=100)


@query("k41_drop_sparse_columns", "SELECT * EXCLUDE (total_amount, spare) FROM f", "dirty_orders")
def k41(d):
    return gaps.drop_sparse_columns(d.fixture("dirty_orders"), ROW)


LINEAR = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_quantity * 3 + l_tax * 100 + 7 END AS y, l_quantity, l_tax FROM {lineitem}"


@query("k42_impute_regression", "SELECT l_orderkey, l_linenumber, round(l_quantity * 3 + l_tax * 100 + 7, 3) AS y FROM lineitem")
def k42(d):
    out = gaps.impute_regression(d.sql(LINEAR), "y", ["l_quantity", "l_tax"])
    return out.select("l_orderkey", "l_linenumber", F.round("y", 3).alias("y"))


@query("k42_impute_columns", "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM f)), 6) AS value FROM f", "dup_events")
def k42_columns(d):
    out = gaps.impute_columns(d.fixture("dup_events").select("event_id", "value"), "value")
    return out.withColumn("value", F.round("value", 6))


@query("k43_missing_flags", "SELECT event_id, value, CAST(value IS NULL AS INTEGER) AS value__is_missing FROM f", "dup_events")
def k43(d):
    return gaps.missing_flags(d.fixture("dup_events").select("event_id", "value"), ["value"])


CATEGORIES = [("low", "minor"), ("5-low", "minor"), ("1-URGENT", "urgent"), (" 2-high ", "high")]


@query(
    "k45_normalize_categories",
    f"SELECT row_id, CASE lower({s.trim('priority')}) WHEN 'low' THEN 'minor' WHEN '5-low' THEN 'minor' WHEN '1-urgent' THEN 'urgent' WHEN '2-high' THEN 'high' ELSE priority END AS priority FROM f",
    "dirty_orders",
)
def k45(d):
    mapping = d.spark.createDataFrame(CATEGORIES, "variant string, category string")
    return consistency.normalize_categories(d.fixture("dirty_orders").select(ROW, "priority"), "priority", mapping)


@query(
    "k46_fix_phone",
    f"SELECT row_id, CASE WHEN NOT {s.valid('phone', 'phone')} AND {s.valid('(' + s.standard('phone', 'phone') + ')', 'phone')} THEN {s.standard('phone', 'phone')} ELSE phone END AS phone FROM f",
    "contacts",
)
def k46(d):
    return d.fixture("contacts").select(ROW, consistency.fix_phone("phone").alias("phone"))


@query("k47_validate_emails", f"SELECT row_id, {s.valid('email', 'email')} AS ok FROM f", "contacts")
def k47(d):
    return d.fixture("contacts").select(ROW, consistency.is_email("email").alias("ok"))


BOOLS = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ' Yes' WHEN doc_id % 4 = 1 THEN CAST(toxic AS STRING) WHEN doc_id % 4 = 2 THEN 'F' ELSE 'maybe' END AS flag FROM {labels}"


@query(
    "k48_normalize_boolean",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN toxic = 1 WHEN 2 THEN false END AS flag FROM labels",
)
def k48(d):
    return d.sql(BOOLS).select("doc_id", consistency.normalize_boolean("flag").alias("flag"))


TYPES = {"total_amount": "double", "priority": "int"}


@query("k49_ensure_types", "SELECT row_id, TRY_CAST(total_amount AS DOUBLE) AS total_amount, CAST(NULL AS INTEGER) AS priority FROM f", "dirty_orders")
def k49(d):
    return consistency.ensure_types(d.fixture("dirty_orders").select(ROW, "total_amount", "priority"), TYPES)


@query(
    "k49_type_rejects",
    "SELECT 'total_amount' AS \"column\", 'double' AS type, CAST(0 AS BIGINT) AS rejects UNION ALL SELECT 'priority', 'int', count(priority) FROM f",
    "dirty_orders",
)
def k49_rejects(d):
    return consistency.type_rejects(d.fixture("dirty_orders"), TYPES)


@query(
    "k50_harmonize_ids",
    "SELECT row_id, lpad(upper(regexp_replace(vehicle, '[^A-Za-z0-9]', '', 'g')), 12, '0') AS vehicle FROM f",
    "contacts",
)
def k50(d):
    return d.fixture("contacts").select(ROW, consistency.harmonize_id("vehicle", 12).alias("vehicle"))


# Every 97th event has a letter dropped or changed, so misspellings are rare.
SPELLING = "SELECT event_id, CASE WHEN event_id % 970 = 0 THEN concat('x', substr(event_type, 2)) WHEN event_id % 970 = 97 THEN substr(event_type, 1, length(event_type) - 1) ELSE event_type END AS kind FROM {events}"


@query(
    "k51_fix_spelling",
    f"WITH t AS ({SPELLING}), c AS (SELECT kind, count(*) AS n FROM t GROUP BY 1), "
    "p AS (SELECT r.kind, g.kind AS good, row_number() OVER (PARTITION BY r.kind ORDER BY g.n DESC, g.kind) AS o FROM c r, c g WHERE r.n < 100 AND g.n >= 100 AND levenshtein(r.kind, g.kind) <= 1) "
    "SELECT event_id, coalesce(good, t.kind) AS kind FROM t LEFT JOIN p ON p.kind = t.kind AND p.o = 1",
)
def k51(d):
    return consistency.fix_spelling(d.sql(SPELLING), "kind", 100)


# Part types with some letters lost or changed.
MISSPELT = """SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN concat('x', substr(n, 2, 3), substr(n, 6)) WHEN p_partkey % 23 = 1 THEN concat(n, 'yy')
    WHEN p_partkey % 23 = 2 THEN concat(substr(n, 1, 2), substr(n, 5)) ELSE n END AS name FROM (SELECT p_partkey, p_type AS n FROM {part}) t"""


@query(
    "k51_fix_spelling_two_edits",
    f"WITH t AS ({MISSPELT}), c AS (SELECT name, count(*) AS n FROM t GROUP BY 1), "
    "p AS (SELECT r.name, g.name AS good, row_number() OVER (PARTITION BY r.name ORDER BY levenshtein(r.name, g.name), g.n DESC, g.name) AS o "
    "FROM c r, c g WHERE r.n < 3 AND g.n >= 3 AND levenshtein(r.name, g.name) <= 2) "
    "SELECT p_partkey, coalesce(good, t.name) AS name FROM t LEFT JOIN p ON p.name = t.name AND p.o = 1",
)
def k51_two(d):
    return consistency.fix_spelling(d.sql(MISSPELT), "name", 3, 2)


@query(
    "k52_validate_totals",
    "SELECT o_orderkey AS key, round(o_totalprice, 2) AS total, round(coalesce(s, 0), 2) AS child_total FROM orders LEFT JOIN "
    "(SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(o_totalprice - coalesce(s, 0)) > 0.01",
)
def k52(d):
    out = checks.validate_totals(
        d.table("orders"), "o_orderkey", "o_totalprice", d.table("lineitem"), "l_orderkey", "l_extendedprice"
    )
    return out.select("key", F.round("total", 2).alias("total"), F.round("child_total", 2).alias("child_total"))


# Every 13th order points at a customer that does not exist.
LOST = "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 13 = 0 THEN -1 - o_custkey WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS cust_id FROM {orders}"


@query(
    "k53_orphan_keys",
    f"SELECT cust_id AS key, count(*) AS rows FROM ({LOST}) WHERE cust_id IS NOT NULL AND cust_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1",
)
def k53(d):
    return checks.orphan_keys(d.sql(LOST), "cust_id", d.table("customer"), "c_custkey")


@query(
    "k53_orphan_rows",
    f"SELECT row_id, cust_id FROM ({LOST}) WHERE cust_id IS NOT NULL AND cust_id NOT IN (SELECT c_custkey FROM customer)",
)
def k53_rows(d):
    return checks.orphan_rows(d.sql(LOST), "cust_id", d.table("customer"), "c_custkey")


@query(
    "k54_verify_calculations",
    "SELECT count(*) AS checked, count(*) FILTER (WHERE l_orderkey % 8 = 0) AS wrong FROM lineitem",
)
def k54(d):
    return numbers.calculation_report(d.sql(LINE), "net", NET, 0.02).select("checked", "wrong")


@query(
    "k55_anomalies",
    "SELECT event_id, round((value - m) / sd, 6) AS z_score, abs((value - m) / sd) > 2 AS anomaly FROM events JOIN "
    "(SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1) USING (event_type)",
)
def k55(d):
    df = d.table("events").select("event_id", "event_type", "value")
    out = checks.anomalies(df, "value", "event_type", 2.0)
    return out.select("event_id", F.round("z_score", 6).alias("z_score"), "anomaly")


@query(
    "k55_iqr_anomalies",
    f"WITH b AS ({_bounds(['value'], 1.5, 'events')}) SELECT event_id, value FROM events, b WHERE value < low OR value > high",
)
def k55_iqr(d):
    return checks.iqr_anomalies(d.table("events").select("event_id", "value"), "value")


@query("k56_validate_patterns", _flags(DATA_COLUMNS["contacts"]), "contacts")
def k56(d):
    out = validation.format_flags(d.fixture("contacts"), ROW)
    return out.withColumn("sample_mismatches", F.array_join("sample_mismatches", "|"))


RULES = {
    "positive quantity": "l_quantity > 0",
    "small discount": "l_discount <= 0.05",
    "known flag": "l_returnflag IN ('A', 'N')",
}


@query(
    "k57_check_rules",
    " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) AS checked, count(*) FILTER (WHERE NOT ({p})) AS failed FROM lineitem" for n, p in RULES.items()
    ),
)
def k57(d):
    return checks.check_rules(d.table("lineitem"), RULES)


@query(
    "k58_cross_reference",
    f"SELECT row_id, cust_id, c_name, c_mktsegment, c_custkey IS NOT NULL AS found FROM ({LOST}) LEFT JOIN customer ON c_custkey = cust_id",
)
def k58(d):
    return checks.cross_reference(
        d.sql(LOST), "cust_id", d.table("customer"), "c_custkey", ["c_name", "c_mktsegment"]
    )


LINKS = "SELECT c_nationkey AS child, CASE WHEN c_custkey % 500 = 0 THEN 9 ELSE n_regionkey END AS parent FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"


@query(
    "k59_hierarchy_breaks",
    f"WITH l AS ({LINKS}) SELECT child, 'several parents' AS problem FROM l GROUP BY 1 HAVING count(DISTINCT parent) > 1 "
    "UNION ALL SELECT DISTINCT child, 'unknown parent' FROM l WHERE parent NOT IN (SELECT r_regionkey FROM region)",
)
def k59(d):
    return checks.hierarchy_breaks(d.sql(LINKS), "child", "parent", d.table("region"), "r_regionkey")

