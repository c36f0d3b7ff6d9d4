"""Queries of suggestions, plans and the cleaning loop (L), and A25."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwash.plans import apply, suggest
from registry import sqltext as s
from registry.base import DATA_COLUMNS, FIXTURES, plain, query
from registry.profile import IS_DATE
from registry.score import measures_sql
from registry.validation import _flags

ORDERS = DATA_COLUMNS["dirty_orders"]
TEXTS = [c for c in ORDERS if c != "cust_id"]
ROW = "row_id"
PLACE = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(ORDERS)) + " END"

SUGGEST = f"""
facts AS (SELECT "column", bool_or(value != {s.trim('value')}) AS padded, count(DISTINCT value) AS raw, count(DISTINCT lower(value)) AS low,
    bool_and({IS_DATE}) AS dates, bool_and({s.plain_number('value')}) AS numbers FROM ({s.sample(TEXTS, 20)}) GROUP BY 1),
base AS ({s.per_column(ORDERS, '(count(*) - count({c})) * 100.0::DOUBLE / count(*) AS pct, count(DISTINCT {c}) = 1 AS single')}),
found AS (
    SELECT 1000000 AS o, "column", 'missing' AS category, format('Column ''{{}}'' has {{:.1f}}% missing values', "column", pct) AS description,
        format('Consider dropping column ''{{}}'' or imputing values', "column") AS action, 'medium' AS priority,
        format('Affects {{:.1f}}% of rows', pct) AS impact, 'keep' AS op FROM base WHERE pct > 70
    UNION ALL SELECT 2000000, "column", 'text', format('Column ''{{}}'' contains leading/trailing whitespace', "column"),
        'Trim whitespace from all values', 'high', 'Improves data consistency', 'trim' FROM facts WHERE padded
    UNION ALL SELECT 2000001, "column", 'text', format('Column ''{{}}'' has inconsistent text case', "column"),
        'Standardize text case', 'medium', format('Reduces unique values from {{}} to {{}}', raw, low), 'title' FROM facts WHERE low < raw
    UNION ALL SELECT 3000000, "column", 'datetime', format('Column ''{{}}'' appears to contain dates as text', "column"),
        'Convert to datetime format', 'high', 'Enables date operations and sorting', 'to_datetime' FROM facts WHERE dates
    UNION ALL SELECT 4000000, "column", 'numerical', format('Column ''{{}}'' contains numbers stored as text', "column"),
        'Convert to numeric type', 'high', 'Enables numeric operations', 'to_numeric' FROM facts WHERE numbers AND NOT dates
    UNION ALL SELECT 5000000, "column", 'structural', format('Column ''{{}}'' contains only one unique value', "column"),
        'Consider dropping this column', 'low', 'Reduces redundant data', 'keep' FROM base WHERE single),
suggested AS (SELECT CAST(o + {PLACE} * 10 AS INTEGER) AS rule_ord, category, description, action, priority, true AS requires_code,
    "column" AS affected_columns, impact, op FROM found
    UNION ALL SELECT 0, 'duplicates', format('Remove {{}} duplicate rows', n), 'Drop duplicate rows keeping first occurrence', 'high', true,
    '{'|'.join(ORDERS)}', format('Removes {{}} rows', n), 'keep' FROM
    (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(ORDERS)} FROM f)) AS n FROM f) WHERE n > 0)
"""


@query("l01_rule_suggestions", f"WITH {SUGGEST} SELECT * FROM suggested", "dirty_orders")
def l01(d):
    out = suggest.rule_suggestions(d.fixture("dirty_orders"), ROW)
    return out.withColumn("affected_columns", F.array_join("affected_columns", "|"))


@query(
    "l02_top_suggestions",
    f"WITH {SUGGEST} SELECT * FROM (SELECT * FROM suggested ORDER BY rule_ord LIMIT 5) WHERE requires_code",
    "dirty_orders",
)
def l02(d):
    out = suggest.top_suggestions(suggest.rule_suggestions(d.fixture("dirty_orders"), ROW))
    return out.withColumn("affected_columns", F.array_join("affected_columns", "|"))


# --- actions over the part table: one free text per remainder -----------------------
ACTIONS = """SELECT p_partkey AS id, CASE p_partkey % 14 WHEN 0 THEN concat('Drop duplicate rows of ', p_name) WHEN 1 THEN 'TRIM all cells'
    WHEN 2 THEN 'drop missing values' WHEN 3 THEN 'Fill null cells' WHEN 4 THEN 'find missing' WHEN 5 THEN 'Convert to numeric type'
    WHEN 6 THEN 'Convert to datetime format' WHEN 7 THEN 'make lowercase' WHEN 8 THEN 'UPPERCASE names' WHEN 9 THEN 'Standardize text case'
    WHEN 10 THEN 'drop this column' WHEN 11 THEN 'rename headers' WHEN 12 THEN 'find outliers' ELSE p_type END AS action FROM {part}"""


@query(
    "l03_route_action",
    f"SELECT id, CASE WHEN contains(a, 'duplicate') THEN 'keep' WHEN contains(a, 'trim') OR contains(a, 'whitespace') THEN 'trim' "
    "WHEN contains(a, 'missing') OR contains(a, 'null') THEN CASE WHEN contains(a, 'drop') THEN 'keep' WHEN contains(a, 'fill') THEN 'fill' ELSE 'mark_missing' END "
    "WHEN contains(a, 'convert') AND contains(a, 'numeric') THEN 'to_numeric' WHEN contains(a, 'date') THEN 'to_datetime' "
    "WHEN contains(a, 'lowercase') OR contains(a, 'uppercase') OR contains(a, 'case') THEN CASE WHEN contains(a, 'lower') THEN 'lower' "
    "WHEN contains(a, 'upper') THEN 'upper' ELSE 'title' END WHEN contains(a, 'column') AND contains(a, 'drop') THEN 'keep' "
    f"WHEN contains(a, 'rename') THEN 'snake_names' WHEN contains(a, 'outlier') THEN 'mark_outliers' ELSE 'keep' END AS op FROM (SELECT id, lower(action) AS a FROM ({ACTIONS}))",
)
def l03(d):
    return d.sql(ACTIONS).select("id", suggest.route_action("action").alias("op"))


def _lowered(c):
    t = s.trim(c)
    return f"CASE WHEN {t} IN ('NULL','null','#N/A','N/A','n/a','#NA') THEN NULL ELSE lower({t}) END AS {c}"


@query(
    "l04_apply_plan",
    "SELECT row_id, cust_id, " + ", ".join(_lowered(c) for c in TEXTS if c != "value_text") + ", concat('EUR ', value_text) AS value_text FROM f",
    "dirty_orders",
)
def l04(d):
    def drops_rows(df):
        return df.where("row_id % 2 = 0")

    steps = ["trim", "null_tokens", "make lowercase", {"value_text": "concat('EUR ', value_text)"}, drops_rows]
    return apply.apply_plan(d.fixture("dirty_orders"), ROW, steps)


# The table after each round, written out by hand for the second engine.
ROUND_1 = f"""SELECT row_id, cust_id, lower({s.trim('priority')}) AS priority,
    strftime({s.date_value('order_date', day_first=False)}, '%Y-%m-%d %H:%M:%S') AS order_date,
    total_amount, value_text, origin, spare FROM base"""
ROUND_2 = f"""SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount,
    CAST(value_text AS DOUBLE) AS value_text) FROM ({ROUND_1})"""
AS_TEXT = {"order_date": "date", "total_amount": "currency_inr"}


def _round(no, table, numerics):
    texts = [c for c in TEXTS if c not in numerics and c != "order_date"]
    measures = measures_sql(ORDERS, texts, numerics, AS_TEXT).replace(
        "total_amount = ''", "CAST(total_amount AS VARCHAR) = ''"
    ).replace("regexp_replace(total_amount,", "regexp_replace(CAST(total_amount AS VARCHAR),")
    return (
        f"SELECT {no} AS iteration, score AS quality_score, 5 AS changes_applied, n_rows AS rows, n_cols AS columns "
        f"FROM (WITH f AS ({table}), {measures} SELECT * FROM total)"
    )


@query(
    "l05_clean_until",
    f"WITH base AS ({plain(FIXTURES['dirty_orders'])}) "
    + _round(1, ROUND_1, ["cust_id"])
    + " UNION ALL "
    + _round(2, ROUND_2, ["cust_id", "total_amount", "value_text"]),
)
def l05(d):
    """History of the loop; the threshold is above the first score, so it runs twice."""
    return apply.clean_until(d.fixture("dirty_orders"), ROW, threshold=95)[1]


@query(
    "l06_basic_clean",
    'SELECT row_id, '
    + ", ".join(
        f"CASE WHEN {s.trim(c)} IN ('NULL','null','#N/A','N/A','n/a','#NA') THEN NULL ELSE {s.trim(c)} END AS \"{n}\""
        for c, n in zip(DATA_COLUMNS["raw_sheet"], ("Name", "Key", "Key_1", "Column_4", "Column_5"))
    )
    + " FROM f WHERE row_id > 1",
    "raw_sheet",
)
def l06(d):
    return apply.basic_clean(d.fixture("raw_sheet"), ROW)[0]


@query(
    "l06_basic_clean_log",
    "SELECT 0 AS step_no, format('Loaded table with shape: ({}, 5)', count(*)) AS change FROM f "
    "UNION ALL SELECT 1, 'Used row 2 as headers, removed 2 rows (header + rows above)' UNION ALL SELECT 2, 'Cleaned 5 column names' "
    "UNION ALL SELECT 3, 'Trimmed whitespace from text values' UNION ALL SELECT 4, 'Standardized NULL representations to NaN'",
    "raw_sheet",
)
def l06_log(d):
    return apply.basic_change_log(d.spark, apply.basic_clean(d.fixture("raw_sheet"), ROW)[1])


@query(
    "l07_quick_suggestions",
    f"WITH {SUGGEST} SELECT rule_ord, concat(action, ': ', description) AS suggestion FROM (SELECT * FROM suggested ORDER BY rule_ord LIMIT 5)",
    "dirty_orders",
)
def l07(d):
    return suggest.quick_suggestions(d.fixture("dirty_orders"), ROW)


def _changed(no, step, new, old="{c}", where="true"):
    return " UNION ALL ".join(
        f"SELECT {no} AS step_no, '{step}' AS step, '{c}' AS \"column\", count(*) FILTER (WHERE {new(c)} IS DISTINCT FROM {old.format(c=c)}) AS changed FROM f"
        for c in TEXTS
    )


@query(
    "l08_change_log",
    "SELECT * FROM ("
    + _changed(0, "trim", s.trim)
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 1, 'null_tokens', '{c}', count(*) FILTER (WHERE {s.trim(c)} IN ('NULL','null','#N/A','N/A','n/a','#NA')) FROM f" for c in TEXTS
    )
    + ") WHERE changed > 0",
    "dirty_orders",
)
def l08(d):
    df, watches = apply.apply_observed(d.fixture("dirty_orders"), ROW, ["trim", "null_tokens"])
    df.write.format("noop").mode("overwrite").save()
    return apply.change_log(d.spark, watches)


@query(
    "a25_cleaning_needed",
    f"""
    WITH facts AS (SELECT "column", bool_or(value != {s.trim('value')}) AS padded,
        bool_and(pos > 20 OR {IS_DATE}) AS dates, bool_and(pos > 20 OR {s.plain_number('value')}) AS numbers FROM ({s.sample(TEXTS, 100)}) GROUP BY 1),
    n AS (SELECT count(*) FILTER (WHERE padded) AS padded, count(*) FILTER (WHERE dates) AS dates_as_text,
        count(*) FILTER (WHERE numbers AND NOT dates) AS numbers_as_text FROM facts),
    fl AS (SELECT count(*) AS format_flags FROM ({_flags(ORDERS)}))
    SELECT padded, dates_as_text, numbers_as_text, format_flags, true AS good_headers,
        padded + dates_as_text + numbers_as_text + format_flags > 0 AS needed FROM n, fl
    """,
    "dirty_orders",
)
def a25(d):
    return suggest.cleaning_needed(d.fixture("dirty_orders"), ROW)
