"""Queries of the profiling operators (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwash.functions import rules
from gridwash.operators import compare, profile, usage
from gridwash.streaming import live
from registry import sqltext as s
from registry.base import DATA_COLUMNS, query

ORDERS = DATA_COLUMNS["dirty_orders"]
TEXTS = [c for c in ORDERS if c != "cust_id"]
ROW = "row_id"
N = len(ORDERS)
ALL_MISSING = " + ".join(f"count(*) - count({c})" for c in ORDERS)
DUPS = "count(*) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {src}))"


@query("a01_table_shape", f"SELECT count(*) AS rows, {N} AS columns, count(*) * {N} AS total_cells FROM f", "dirty_orders")
def a01(d):
    return profile.table_shape(d.fixture("dirty_orders"), ROW)


@query(
    "a02_missing_by_column",
    s.per_column(
        ORDERS,
        "count(*) - count({c}) AS missing_count, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS missing_percent",
    ),
    "dirty_orders",
)
def a02(d):
    return profile.missing_by_column(d.fixture("dirty_orders"), ROW)


@query(
    "a03_missing_overall",
    f"SELECT {ALL_MISSING} AS missing_cells, count(*) * {N} AS total_cells, "
    f"({ALL_MISSING}) * 100.0::DOUBLE / (count(*) * {N}) AS missing_percent FROM f",
    "dirty_orders",
)
def a03(d):
    return profile.missing_overall(d.fixture("dirty_orders"), ROW)


@query(
    "a04_duplicate_rows",
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS duplicate_rows FROM f",
    "dup_events",
)
def a04(d):
    return profile.duplicate_rows(d.fixture("dup_events"))


@query(
    "a04_duplicate_rows_by_digest",
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS duplicate_rows FROM f",
    "dup_events",
)
def a04_digest(d):
    return profile.duplicate_rows(d.fixture("dup_events"), digest=True)


@query(
    "a05_any_defects",
    "SELECT count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS any_duplicates, "
    "bool_or(event_id IS NULL OR user_id IS NULL OR event_type IS NULL OR value IS NULL) AS any_nulls FROM f",
    "dup_events",
)
def a05(d):
    return profile.any_defects(d.fixture("dup_events"))


@query("a06_unique_count", s.per_column(ORDERS, "count(DISTINCT {c}) AS unique_count"), "dirty_orders")
def a06(d):
    return profile.unique_count(d.fixture("dirty_orders"), ROW)


@query("a06_unique_count_approx")
def a06_approx(d):
    return profile.unique_count(d.fixture("dirty_orders"), ROW, approx=True)


@query(
    "a07_single_value_columns",
    f"SELECT \"column\" FROM ({s.per_column(ORDERS, 'count(DISTINCT {c}) AS n')}) WHERE n = 1",
    "dirty_orders",
)
def a07(d):
    return profile.single_value_columns(d.fixture("dirty_orders"), ROW)


@query(
    "a08_empty_counts",
    "SELECT count(*) FILTER (WHERE c0 IS NULL AND c1 IS NULL AND c2 IS NULL AND c3 IS NULL AND c4 IS NULL) AS empty_rows, "
    + " + ".join(f"CAST(count({c}) = 0 AS BIGINT)" for c in DATA_COLUMNS["raw_sheet"])
    + " AS empty_columns FROM f",
    "raw_sheet",
)
def a08(d):
    return profile.empty_counts(d.fixture("raw_sheet"), ROW)


@query(
    "a08_empty_counts_orders",
    "SELECT CAST(0 AS BIGINT) + count(*) FILTER (WHERE "
    + " AND ".join(f"{c} IS NULL" for c in ORDERS)
    + ") AS empty_rows, "
    + " + ".join(f"CAST(count({c}) = 0 AS BIGINT)" for c in ORDERS)
    + " AS empty_columns FROM f",
    "dirty_orders",
)
def a08_orders(d):
    return profile.empty_counts(d.fixture("dirty_orders"), ROW)


LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a09_numeric_stats",
    s.per_column(
        LINES,
        "round(min({c}), 2) AS min, round(max({c}), 2) AS max, round(avg({c}), 2) AS mean",
        "lineitem",
    ),
)
def a09(d):
    return profile.numeric_stats(d.table("lineitem").select(*LINES))


@query(
    "a10_describe_dates",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, make_timestamp(CAST(round(avg(epoch_us({c}))) AS BIGINT)) AS mean, min({c}) AS min, "
        + ", ".join(f"make_timestamp(CAST(round(quantile_cont(epoch_us({c}), 0.{q})) AS BIGINT)) AS q{q}" for q in (25, 50, 75))
        + f", max({c}) AS max FROM {t}"
        for t, c in (("lineitem", "l_shipdate"),)
    ),
)
def a10_dates(d):
    return profile.describe_dates(d.table("lineitem").select("l_linenumber", "l_shipdate"))


@query(
    "a10_describe",
    s.per_column(
        LINES,
        "count({c}) AS count, round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std, min({c}) AS min, "
        "round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
        "round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max",
        "lineitem",
    ),
)
def a10(d):
    out = profile.describe(d.table("lineitem").select(*LINES))
    digits = {"mean": 9, "std": 9, "q25": 6, "q50": 6, "q75": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "a11_type_counts",
    "SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
    "WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS dtype, "
    "CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'text' "
    "ELSE 'datetime' END AS kind, count(*) AS columns FROM (SELECT unnest([typeof(l_orderkey), typeof(l_partkey), "
    "typeof(l_suppkey), typeof(l_linenumber), typeof(l_quantity), typeof(l_extendedprice), typeof(l_discount), "
    "typeof(l_tax), typeof(l_returnflag), typeof(l_linestatus), typeof(l_shipdate)]) AS data_type "
    "FROM (SELECT * FROM lineitem LIMIT 1)) GROUP BY ALL",
)
def a11(d):
    return profile.type_counts(d.table("lineitem"))


@query(
    "a12_sample_values",
    f"SELECT \"column\", string_agg(value, '|' ORDER BY pos) AS samples FROM ({s.sample(ORDERS, 5)}) GROUP BY 1",
    "dirty_orders",
)
def a12(d):
    out = profile.sample_values(d.fixture("dirty_orders"), ROW)
    return out.withColumn("samples", F.array_join("samples", "|"))


@query(
    "a12_sample_values_distinct",
    f"SELECT \"column\", string_agg(value, '|' ORDER BY pos) AS samples FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY \"column\" ORDER BY first_seen, value) AS pos FROM (SELECT \"column\", value, min(row_id) AS first_seen "
    f"FROM ({s.cells(ORDERS)}) GROUP BY 1, 2)) WHERE pos <= 5 GROUP BY 1",
    "dirty_orders",
)
def a12_distinct(d):
    out = profile.sample_values(d.fixture("dirty_orders"), ROW, distinct=True)
    return out.withColumn("samples", F.array_join("samples", "|"))


for _k in (10, 20, 100):

    @query(
        f"a13_whitespace_columns_first{_k}",
        f"SELECT DISTINCT \"column\" FROM ({s.sample(TEXTS, _k)}) WHERE value != {s.trim('value')}",
        "dirty_orders",
    )
    def a13(d, k=_k):
        return profile.whitespace_columns(d.fixture("dirty_orders"), ROW, k)


@query(
    "a14_inconsistent_case_columns",
    f"SELECT * FROM (SELECT \"column\", count(DISTINCT value) AS distinct_raw, count(DISTINCT lower(value)) AS distinct_lower "
    f"FROM ({s.sample(TEXTS, 20)}) GROUP BY 1) WHERE distinct_lower < distinct_raw",
    "dirty_orders",
)
def a14(d):
    return profile.inconsistent_case_columns(d.fixture("dirty_orders"), ROW)


IS_DATE = f"{s.date_value('value', day_first=False, bare_years=True)} IS NOT NULL"


# Dates, years and amounts as text, keyed by order: columns that pass the two type tests.
TYPED_SQL = """SELECT o_orderkey AS row_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day_text,
       CAST(year(o_orderdate) AS STRING) AS year_text,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price_text,
       o_orderpriority AS priority FROM {orders}"""
TYPED = ["day_text", "year_text", "price_text", "priority"]
TYPED_TWIN = "WITH f AS (" + TYPED_SQL + ") "


@query(
    "a15_potentially_datetime",
    TYPED_TWIN + f"SELECT \"column\" FROM ({s.sample(TYPED, 20)}) GROUP BY 1 HAVING bool_and({IS_DATE})",
)
def a15(d):
    return profile.potentially_datetime(d.sql(TYPED_SQL), ROW)


@query(
    "a16_potentially_numeric_text",
    TYPED_TWIN
    + f"SELECT \"column\" FROM ({s.sample(TYPED, 20)}) GROUP BY 1 HAVING NOT bool_and({IS_DATE}) AND bool_and({s.plain_number('value')})",
)
def a16(d):
    return profile.potentially_numeric_text(d.sql(TYPED_SQL), ROW)


@query(
    "a17_high_missing_columns",
    f"SELECT * FROM ({s.per_column(ORDERS, '(count(*) - count({c})) * 100.0::DOUBLE / count(*) AS missing_percent')}) WHERE missing_percent > 50",
    "dirty_orders",
)
def a17(d):
    return profile.high_missing_columns(d.fixture("dirty_orders"), ROW)


def _mixed_counts(columns):
    return (
        f"SELECT \"column\", count(*) FILTER (WHERE {s.number('value')}) AS n_number, "
        f"count(*) FILTER (WHERE {s.date_like('value')}) AS n_date, "
        f"count(*) - count(*) FILTER (WHERE {s.number('value')}) - count(*) FILTER (WHERE {s.date_like('value')}) AS n_text "
        f"FROM ({s.sample(columns, 20)}) GROUP BY 1"
    )


def _mixed(columns):
    return (
        f"SELECT m.*, t.non_null, (t.non_null > 1 AND n_number > 0 AND n_date > 0 AND n_text > 0 AND n_number > non_null * 0.2 "
        f"AND n_date > non_null * 0.2 AND n_text > non_null * 0.2) AS severe FROM ({_mixed_counts(columns)}) m "
        f"JOIN ({s.per_column(columns, 'count({c}) AS non_null')}) t ON m.\"column\" = t.\"column\""
    )


@query(
    "a18_column_profile",
    f"""
    WITH base AS ({s.per_column(ORDERS, '''CASE WHEN {n} = 'cust_id' THEN 'bigint' ELSE 'string' END AS dtype, count(*) AS total_count,
        count({c}) AS non_null_count, count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percent, count(DISTINCT {c}) AS unique_count,
        CASE WHEN {n} = 'cust_id' THEN round(CAST(min(cust_id) AS DOUBLE), 2) END AS min,
        CASE WHEN {n} = 'cust_id' THEN round(CAST(max(cust_id) AS DOUBLE), 2) END AS max,
        CASE WHEN {n} = 'cust_id' THEN round(avg(cust_id), 2) END AS mean''')}),
    seen AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY min(row_id), value) AS pos
             FROM ({s.cells(ORDERS)}) GROUP BY 1, 2),
    samples AS (SELECT "column", string_agg(value, '|' ORDER BY pos) AS samples FROM seen WHERE pos <= 5 GROUP BY 1),
    pad AS (SELECT "column", bool_or(value != {s.trim('value')}) AS padded FROM ({s.sample(TEXTS, 100)}) GROUP BY 1),
    mix AS ({_mixed(TEXTS)})
    SELECT base.*, coalesce(samples.samples, '') AS samples, coalesce(padded, false) AS has_whitespace_issues,
           coalesce(severe, false) AS has_mixed_types
    FROM base LEFT JOIN samples USING ("column") LEFT JOIN pad USING ("column") LEFT JOIN mix USING ("column")
    """,
    "dirty_orders",
)
def a18(d):
    out = profile.column_profile(d.fixture("dirty_orders"), ROW)
    return out.withColumn("samples", F.array_join("samples", "|"))


@query(
    "a19_generate_metadata",
    f"""
    WITH smp AS ({s.sample(TEXTS, 20)}),
    kinds AS (SELECT "column", bool_and({IS_DATE}) AS dates, bool_and({s.plain_number('value')}) AS numbers FROM smp GROUP BY 1),
    miss AS ({s.per_column(ORDERS, '(count(*) - count({c})) * 1.0 / count(*) AS ratio')})
    SELECT count(*) AS rows, {N} AS columns, count(*) * {N} AS total_cells,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(ORDERS)} FROM f)) AS duplicate_rows,
      (SELECT {s.join_list('"column"', '"column"')} FROM kinds WHERE dates) AS potentially_datetime,
      (SELECT {s.join_list('"column"', '"column"')} FROM kinds WHERE numbers AND NOT dates) AS potentially_numeric_text,
      (SELECT {s.join_list('"column"', '"column"')} FROM miss WHERE ratio > 0.5) AS high_missing_columns,
      count(*) - count(cust_id) AS cust_id_missing FROM f
    """,
    "dirty_orders",
)
def a19(d):
    out = profile.generate_metadata(d.fixture("dirty_orders"), ROW)
    lists = ("potentially_datetime", "potentially_numeric_text", "high_missing_columns")
    return out.select(
        "rows",
        "columns",
        "total_cells",
        "duplicate_rows",
        *[F.array_join(c, "|").alias(c) for c in lists],
        F.col("missing_values")["cust_id"].alias("cust_id_missing"),
    )


@query(
    "a20_quality_issues",
    f"""
    WITH facts AS (SELECT "column", bool_or(pos <= 10 AND value != {s.trim('value')}) AS padded,
        bool_and(pos > 20 OR {IS_DATE}) AS dates, bool_and(pos > 20 OR {s.plain_number('value')}) AS numbers
        FROM ({s.sample(TEXTS, 20)}) GROUP BY 1),
    base AS ({s.per_column(ORDERS, '(count(*) - count({c})) * 100.0::DOUBLE / count(*) AS pct, count(DISTINCT {c}) = 1 AS single')})
    SELECT "column", format('Column ''{{}}'' has {{:.1f}}% missing values', "column", pct) AS issue FROM base WHERE pct > 50
    UNION ALL SELECT "column", format('Column ''{{}}'' has only one unique value', "column") FROM base WHERE single
    UNION ALL SELECT "column", format('Column ''{{}}'' has leading/trailing whitespace', "column") FROM facts WHERE padded
    UNION ALL SELECT "column", format('Column ''{{}}'' appears to contain dates stored as text', "column") FROM facts WHERE dates
    UNION ALL SELECT "column", format('Column ''{{}}'' appears to contain numbers stored as text', "column") FROM facts WHERE numbers AND NOT dates
    UNION ALL SELECT NULL, format('Found {{}} duplicate rows', n) FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(ORDERS)} FROM f)) AS n FROM f) WHERE n > 0
    """,
    "dirty_orders",
)
def a20(d):
    return profile.quality_issues(d.fixture("dirty_orders"), ROW).select("column", "issue")


def _bounds(cols, factor, source="f"):
    return s.per_column(
        cols,
        f"quantile_cont({{c}}, 0.25) - {factor} * (quantile_cont({{c}}, 0.75) - quantile_cont({{c}}, 0.25)) AS low, "
        f"quantile_cont({{c}}, 0.75) + {factor} * (quantile_cont({{c}}, 0.75) - quantile_cont({{c}}, 0.25)) AS high",
        source,
    )


QTY = DATA_COLUMNS["outlier_lines"]


@query(
    "a21_outlier_ratio",
    f"WITH b AS ({_bounds(QTY, 5)}) SELECT b.\"column\", count(v.value) AS n_values, "
    "count(*) FILTER (WHERE v.value < low OR v.value > high) AS n_outliers, "
    "count(*) FILTER (WHERE v.value < low OR v.value > high) / count(v.value) AS outlier_ratio "
    "FROM (SELECT 'qty' AS \"column\", qty AS value FROM f UNION ALL SELECT 'discount', discount FROM f) v "
    "JOIN b USING (\"column\") WHERE high > low GROUP BY 1",
    "outlier_lines",
)
def a21(d):
    return profile.outlier_ratio(d.fixture("outlier_lines"), ROW)


@query(
    "a22_flag_outliers",
    f"WITH b AS ({_bounds(['value'], 1.5, 'events')}) SELECT event_id, value, value < low OR value > high AS value__outlier FROM events, b",
)
def a22(d):
    df = d.table("events").select("event_id", "value")
    return profile.flag_outliers(df, "event_id")


@query("a23_mixed_type_columns", _mixed(DATA_COLUMNS["mixed_small"]), "mixed_small")
def a23(d):
    return profile.mixed_type_columns(d.fixture("mixed_small"), ROW)


@query("a23_mixed_type_columns_orders", _mixed([c for c in TEXTS if c != "spare"]), "dirty_orders")
def a23_orders(d):
    return profile.mixed_type_columns(d.fixture("dirty_orders"), ROW)


@query("a24_memory_usage", "SELECT CAST(sum(strlen(to_json({'event_id': event_id, 'event_type': event_type}))) AS BIGINT) AS logical_bytes FROM events")
def a24(d):
    return profile.memory_usage(d.table("events").select("event_id", "event_type"))


CALLS = "conv_id, turn"


@query(
    "a27_usage_cost",
    "SELECT provider, CAST(count(*) AS BIGINT) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, "
    "CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, "
    "round(sum(input_tokens) * CASE provider WHEN 'a' THEN 3.0 ELSE 30.0 END / 1000000.0 + "
    "sum(output_tokens) * CASE provider WHEN 'a' THEN 15.0 ELSE 60.0 END / 1000000.0, 6) AS cost FROM f GROUP BY provider",
    "ai_calls",
)
def a27(d):
    return usage.usage_cost(d.fixture("ai_calls")).withColumn("cost", F.round("cost", 6))


@query(
    "a27_usage_running",
    "SELECT conv_id, turn, CAST(input_tokens + output_tokens AS BIGINT) AS tokens, CAST(sum(input_tokens + output_tokens) "
    "OVER (PARTITION BY provider ORDER BY conv_id, turn) AS BIGINT) AS running_tokens, "
    "CAST(coalesce(input_tokens + output_tokens - lag(input_tokens + output_tokens) OVER (PARTITION BY provider ORDER BY conv_id, turn), 0) AS BIGINT) AS delta FROM f",
    "ai_calls",
)
def a27_running(d):
    return usage.running_usage(d.fixture("ai_calls"), ["provider"], ["conv_id", "turn"]).select(
        "conv_id", "turn", "tokens", "running_tokens", "delta"
    )


# Three price periods per provider; provider c has none, every 50th call has no time.
DATED_CALLS = """SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'b' WHEN user_id % 17 = 3 THEN 'c' ELSE 'a' END AS provider,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS ts, event_id % 300 AS input_tokens, event_id % 170 AS output_tokens FROM {events}"""
DATED_PRICES = " UNION ALL ".join(
    f"SELECT '{p}' AS provider, CAST('2024-01-{day} 00:00:00' AS TIMESTAMP) AS valid_from, CAST({a} AS DOUBLE) AS input_price, CAST({b} AS DOUBLE) AS output_price"
    for p, day, a, b in (
        ("a", "03", 3, 15), ("a", "12", 2.5, 12), ("a", "20", 4, 16), ("b", "01", 30, 60), ("b", "10", 25, 50), ("b", "25", 10, 30),
    )
)


@query(
    "a27_usage_cost_by_date",
    f"WITH calls AS ({DATED_CALLS}), prices AS ({DATED_PRICES}) "
    "SELECT provider, input_price, output_price, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, "
    "CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, "
    "round(sum(input_tokens) * input_price / 1000000.0 + sum(output_tokens) * output_price / 1000000.0, 6) AS cost "
    "FROM (SELECT c.provider, c.input_tokens, c.output_tokens, p.input_price, p.output_price FROM calls c "
    "ASOF LEFT JOIN prices p ON c.provider = p.provider AND c.ts >= p.valid_from) GROUP BY provider, input_price, output_price",
)
def a27_by_date(d):
    out = usage.usage_cost_by_date(d.sql(DATED_CALLS), d.sql(DATED_PRICES))
    return out.withColumn("cost", F.round("cost", 6))


@query(
    "a28_sessions",
    "WITH marked AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 30 MINUTE AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "numbered AS (SELECT *, count(*) FILTER (WHERE cut) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked) "
    "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, "
    "count(*) AS events, round(sum(value), 4) AS value FROM numbered GROUP BY user_id, session",
)
def a28_sessions(d):
    found = live.sessions(d.table("events"), "user_id", "30 minutes", values=["value"])
    text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("session_start", "session_end")]
    return found.select("user_id", *text, "events", F.round("value", 4).alias("value"))


# Some rows of one version are gone in the other, and some are changed.
AFTER = "SELECT event_id, user_id, CASE WHEN event_id % 13 = 0 THEN 'changed' ELSE event_type END AS event_type, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM f WHERE event_id % 29 <> 0"
ALL_EVENTS = "event_id, user_id, event_type, value"


def _except_all(change, one, other):
    return f"SELECT '{change}' AS change, count(*) AS copies, {ALL_EVENTS} FROM (SELECT {ALL_EVENTS} FROM {one} EXCEPT ALL SELECT {ALL_EVENTS} FROM {other}) GROUP BY ALL"


@query(
    "a26_row_difference",
    f"WITH g AS ({AFTER}) {_except_all('lost', 'f', 'g')} UNION ALL {_except_all('added', 'g', 'f')}",
    "dup_events",
)
def a26_rows(d):
    before = d.fixture("dup_events")
    return compare.row_difference(before, d.spark.sql(AFTER.replace("FROM f", "FROM {f}"), f=before))


@query(
    "a26_changed_cells",
    "WITH g AS (SELECT row_id, cust_id, trim(priority) AS priority, NULL AS total_amount, value_text FROM f WHERE row_id % 3 <> 0), "
    "j AS (SELECT f.*, g.cust_id AS a0, g.priority AS a1, CAST(g.total_amount AS VARCHAR) AS a2, g.value_text AS a3 FROM f JOIN g USING (row_id)) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS common, count(*) FILTER (WHERE {c} IS DISTINCT FROM a{i}) AS changed, "
        f"count(*) FILTER (WHERE {c} IS NULL AND a{i} IS NOT NULL) AS filled, count(*) FILTER (WHERE {c} IS NOT NULL AND a{i} IS NULL) AS emptied FROM j"
        for i, c in enumerate(("cust_id", "priority", "total_amount", "value_text"))
    ),
    "dirty_orders",
)
def a26_cells(d):
    before = d.fixture("dirty_orders").select("row_id", "cust_id", "priority", "total_amount", "value_text")
    after = before.where("row_id % 3 <> 0").withColumns({"priority": F.trim("priority"), "total_amount": F.lit(None).cast("string")})
    return compare.changed_cells(before, after, "row_id")


@query(
    "a28_rate_limit_breaches",
    "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS window_start, 'uploads' AS kind, count(*) AS n, "
    "CAST(100 AS BIGINT) AS \"limit\" FROM (SELECT ts, event_type FROM events) GROUP BY 1 HAVING count(*) > 100 "
    "UNION ALL SELECT strftime(time_bucket(INTERVAL '1 minute', ts), '%Y-%m-%d %H:%M'), 'requests', count(*), 2 "
    "FROM events GROUP BY 1 HAVING count(*) > 2",
)
def a28(d):
    events = d.table("events")
    log = events.select("ts", F.lit("uploads").alias("kind")).unionByName(
        events.select("ts", F.lit("requests").alias("kind"))
    )
    limits = {**rules.LIMITS, "requests": (2, "1 minute")}
    return usage.rate_limit_breaches(log, limits=limits).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")
    )
