"""Queries of the cell-level functions (C) over the dirty fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwash.functions import cells, formats
from gridwash.operators import convert
from registry import sqltext as s
from registry.base import query

TEXTS = ["priority", "order_date", "total_amount", "value_text", "origin", "spare"]


def _over_text(fmt: str) -> str:
    return ", ".join(f"{fmt.format(c=c)} AS {c}" for c in TEXTS)


@query(
    "c01_trim_text",
    f"SELECT row_id, cust_id, {', '.join(f'{s.trim(c)} AS {c}' for c in TEXTS)} FROM f",
    "dirty_orders",
)
def c01(d):
    return convert.trim_all(d.fixture("dirty_orders"), "row_id")


@query(
    "c02_null_tokens",
    "SELECT row_id, CASE WHEN {t} IN ('NULL','null','#N/A','N/A','n/a','#NA') THEN NULL ELSE {t} END "
    "AS priority FROM f".replace("{t}", s.trim("priority")),
    "dirty_orders",
)
def c02(d):
    df = d.fixture("dirty_orders").select("row_id", "priority")
    return convert.null_all_tokens(convert.trim_all(df, "row_id"), "row_id")


@query(
    "c03_fill_missing",
    "SELECT row_id, cust_id, " + _over_text("coalesce({c}, '')") + " FROM f",
    "dirty_orders",
)
def c03(d):
    return convert.fill_missing(d.fixture("dirty_orders"), "", "row_id")


@query(
    "c04_missing_mask",
    "SELECT row_id, cust_id IS NULL AS cust_id__missing, "
    + ", ".join(f"{c} IS NULL AS {c}__missing" for c in TEXTS)
    + " FROM f",
    "dirty_orders",
)
def c04(d):
    out = convert.missing_mask(d.fixture("dirty_orders"), "row_id")
    return out.select("row_id", *[c for c in out.columns if c.endswith("__missing")])


@query(
    "c05_to_numeric_safe",
    "SELECT row_id, priority, CAST(total_amount AS DOUBLE) AS total_amount, "
    "CAST(value_text AS DOUBLE) AS value_text FROM f",
    "dirty_orders",
)
def c05(d):
    out = convert.to_numeric_safe(d.fixture("dirty_orders"), "row_id")
    return out.select("row_id", "priority", "total_amount", "value_text")


@query(
    "c06_to_datetime_safe",
    f"SELECT row_id, strftime({s.date_value('order_date', day_first=False)}, '%Y-%m-%d') AS order_date, value_text FROM f",
    "dirty_orders",
)
def c06(d):
    df = d.fixture("dirty_orders").select("row_id", "order_date", "value_text")
    out = convert.to_datetime_safe(df, "row_id")
    return out.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query(
    "c07_case_text",
    "SELECT row_id, lower(priority) AS low, upper(priority) AS up, lower(origin) AS origin FROM f",
    "dirty_orders",
)
def c07(d):
    df = d.fixture("dirty_orders")
    return df.select(
        "row_id",
        cells.case_text("priority", "lower").alias("low"),
        cells.case_text("priority", "upper").alias("up"),
        F.lower(cells.case_text("origin", "title")).alias("origin"),
    )


@query(
    "c08_standardize_dates",
    f"SELECT row_id, coalesce(strftime({s.date_value('order_date')}, '%Y/%m/%d'), order_date) AS order_date, "
    "value_text FROM f",
    "dirty_orders",
)
def c08(d):
    df = d.fixture("dirty_orders").select("row_id", "order_date", "value_text")
    return convert.standardize_dates(df, "row_id")


@query(
    "c09_is_number",
    f"SELECT row_id, coalesce({s.number('amount')}, false) AS amount, coalesce({s.number('tax_rate')}, false) AS tax_rate, "
    f"coalesce({s.number('host')}, false) AS host FROM f",
    "contacts",
)
def c09(d):
    df = d.fixture("contacts")
    flag = lambda c: F.coalesce(cells.is_number(c), F.lit(False)).alias(c)
    return df.select("row_id", flag("amount"), flag("tax_rate"), flag("host"))


@query(
    "c10_is_date",
    f"SELECT row_id, coalesce({s.date_like('order_date')}, false) AS order_date, "
    f"coalesce({s.date_like('priority')}, false) AS priority FROM f",
    "dirty_orders",
)
def c10(d):
    flag = lambda c: F.coalesce(cells.is_date(c), F.lit(False)).alias(c)
    return d.fixture("dirty_orders").select("row_id", flag("order_date"), flag("priority"))


def _tag(c):
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN {s.has(c, '[/-]')} AND {s.has(c, '[0-9]')} THEN 'date-like' "
        f"WHEN {s.has(f'''translate({c}, '.,-', '')''', '^[0-9]+$')} THEN 'numeric-string' ELSE 'text' END AS {c}"
    )


@query(
    "c11_type_tag",
    "SELECT row_id, CASE WHEN cust_id IS NOT NULL THEN 'numeric' END AS cust_id, "
    + ", ".join(_tag(c) for c in TEXTS)
    + " FROM f",
    "dirty_orders",
)
def c11(d):
    df = d.fixture("dirty_orders")
    return df.select(
        "row_id",
        *[cells.type_tag(f.name, f.dataType).alias(f.name) for f in df.schema if f.name != "row_id"],
    )


STANDARD = {
    "phone": "phone",
    "gst": "gst",
    "pan": "pan",
    "tax_rate": "percentage",
    "amount": "currency_inr",
    "email": "email",
}


@query(
    "c12_standardize_value",
    "SELECT row_id, " + ", ".join(f"{s.standard(c, k)} AS {c}" for c, k in STANDARD.items()) + " FROM f",
    "contacts",
)
def c12(d):
    df = d.fixture("contacts")
    return df.select(
        "row_id", *[formats.standardize_value(c, k).alias(c) for c, k in STANDARD.items()]
    )


@query(
    "c12_standardize_value_date",
    f"SELECT row_id, {s.standard('order_date', 'date')} AS order_date FROM f",
    "dirty_orders",
)
def c12_date(d):
    df = d.fixture("dirty_orders")
    return df.select("row_id", formats.standardize_value("order_date", "date").alias("order_date"))


def _fix(c):
    up, digits = f"upper({s.trim(c)})", rf"regexp_replace({c}, '\D', '', 'g')"
    return (
        f"concat_ws('|', CASE WHEN {s.has(up, '^[A-Z]{5}[0-9]{4}.$')} THEN concat('Possible PAN: ', {up}) END, "
        f"CASE WHEN length({digits}) = 12 THEN concat('Possible Aadhaar: ', {digits}[1:4], ' ', {digits}[5:8], ' ', {digits}[9:12]) END, "
        f"CASE WHEN {s.has(digits, '^[6-9][0-9]{9}$')} THEN concat('Possible Mobile: +91-', {digits}) "
        f"WHEN {s.has(digits, '^91[0-9]{10}$')} THEN concat('Possible Mobile: +91-', {digits}[3:12]) END) AS {c}"
    )


@query(
    "c13_suggest_fix",
    f"SELECT row_id, {_fix('phone')}, {_fix('pan')}, {_fix('aadhaar')} FROM f",
    "contacts",
)
def c13(d):
    df = d.fixture("contacts")
    return df.select(
        "row_id",
        *[F.array_join(formats.suggest_fix(c), "|").alias(c) for c in ("phone", "pan", "aadhaar")],
    )


@query(
    "c14_json_field",
    """
    WITH k AS (SELECT event_id, props, json_keys(props)[1] AS k FROM events)
    SELECT event_id, json_extract_string(props, '$.k') AS k_value, props AS body FROM k
    """,
)
def c14(d):
    wrapped = d.table("events").select(
        "event_id", F.concat(F.lit("note: "), "props", F.lit(" end")).alias("text")
    )
    return wrapped.select(
        "event_id",
        cells.json_field("text", "$.k").alias("k_value"),
        cells.json_body("text").alias("body"),
    )


@query(
    "c15_parse_bool",
    "SELECT event_id, coalesce(lower(CASE WHEN event_id % 3 = 0 THEN 'True' WHEN event_id % 3 = 1 THEN 'no' END) = 'true', true) AS flag FROM events",
)
def c15(d):
    text = F.expr("CASE WHEN event_id % 3 = 0 THEN 'True' WHEN event_id % 3 = 1 THEN 'no' END")
    return d.table("events").select("event_id", cells.parse_bool(text, True).alias("flag"))


@query(
    "c16_safe_str",
    "SELECT o_orderkey AS row_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)::VARCHAR AS price, "
    "CAST(o_custkey AS VARCHAR) AS cust FROM orders",
)
def c16(d):
    df = d.table("orders").withColumn("p", F.expr("CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)"))
    return df.select(
        F.col("o_orderkey").alias("row_id"),
        cells.safe_str("p", df.schema["p"].dataType).alias("price"),
        cells.safe_str("o_custkey").alias("cust"),
    )


@query(
    "c17_standardize_by_format",
    f"""
    SELECT row_id, phone, email, {s.trim('pan')} AS pan, pincode, host, tax_rate,
           CASE WHEN {s.has(s.trim('amount'), '^[₹$€£¥]')} THEN amount ELSE amount END AS amount
    FROM (SELECT * REPLACE (
        CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) = 12 AND NOT phone LIKE '5%'
             THEN regexp_replace(regexp_replace(phone, '[^0-9]', '', 'g'), '^(..)(....)(......)$', '+\\1 \\2 \\3')
             WHEN regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^[6-9][0-9]{{9}}$')
             THEN regexp_replace(concat('91', regexp_replace(phone, '[^0-9]', '', 'g')), '^(..)(....)(......)$', '+\\1 \\2 \\3')
             ELSE phone END AS phone,
        CASE WHEN regexp_matches(tax_rate, '^[0-9.]+%$') THEN concat(format('{{:.2f}}', CAST(rtrim(tax_rate, '%') AS DOUBLE)), '%')
             ELSE tax_rate END AS tax_rate) FROM f)
    """,
    "contacts",
)
def c17(d):
    df = d.fixture("contacts").select(
        "row_id", "phone", "email", "pan", "pincode", "host", "tax_rate", "amount"
    )
    return convert.standardize_by_format(df, "row_id")


@query(
    "c17_standardize_by_format_dates",
    f"SELECT row_id, coalesce(strftime({s.date_value('order_date')}, '%Y/%m/%d'), order_date) AS order_date, origin FROM f",
    "dirty_orders",
)
def c17_dates(d):
    df = d.fixture("dirty_orders").select("row_id", "order_date", "origin")
    return convert.standardize_by_format(df, "row_id")


