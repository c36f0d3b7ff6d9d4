"""Registry of queries and their SQL twins, and the fixtures they start from.

A fixture is one SQL text over the given tables that both engines can read; a
query starts from the fixture DataFrame, its twin from ``WITH f AS (fixture)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class Data:
    """The given tables and the fixtures derived from them, for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def fixture(self, name: str) -> DataFrame:
        return self.sql(FIXTURES[name])

    def sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)


def query(name: str, sql: str | None = None, fixture: str | None = None):
    """Register ``f(data) -> DataFrame``; ``sql`` is the twin, over ``f`` if a fixture is named."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            if fixture is not None:
                body = plain(FIXTURES[fixture]).strip()
                rest = text[4:].lstrip() if text.upper().startswith("WITH") else None
                text = f"WITH f AS ({body})" + (f", {rest}" if rest else f"\n{text}")
            ORACLE[name] = plain(text)
        return f

    return register


def plain(text: str) -> str:
    """SQL text with bare table names."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


FIXTURES = {
    "dirty_orders": """
SELECT o_orderkey AS row_id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS cust_id,
       CASE WHEN o_orderkey % 5 = 0 THEN concat('  ', o_orderpriority, ' ')
            WHEN o_orderkey % 5 = 1 THEN lower(o_orderpriority)
            WHEN o_orderkey % 17 = 0 THEN 'N/A'
            ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 4 = 0 THEN concat(substr(d, 9, 2), '/', substr(d, 6, 2), '/', substr(d, 1, 4))
            WHEN o_orderkey % 4 = 1 THEN concat(substr(d, 9, 2), '-', substr(d, 6, 2), '-', substr(d, 3, 2))
            WHEN o_orderkey % 4 = 2 THEN d
            WHEN o_orderkey % 13 = 0 THEN 'unknown'
            ELSE concat(substr(d, 9, 2), '-', substr(d, 6, 2), '-', substr(d, 1, 4)) END AS order_date,
       CASE WHEN o_orderkey % 10 < 8 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS total_amount,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS value_text,
       'ERP' AS origin,
       CAST(NULL AS STRING) AS spare
FROM (SELECT o.*, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM {orders} o) t
""",
    "contacts": """
SELECT c_custkey AS row_id,
       CASE WHEN c_custkey % 6 = 0 THEN concat('+91-', m) WHEN c_custkey % 6 = 1 THEN concat(substr(m, 1, 5), ' ', substr(m, 6, 5))
            WHEN c_custkey % 6 = 2 THEN concat('91', m) WHEN c_custkey % 6 = 3 THEN concat('5', substr(m, 2, 9)) ELSE m END AS phone,
       CASE WHEN c_custkey % 9 = 0 THEN concat('user', k, '.example.com') ELSE concat('user', k, '@example.com') END AS email,
       CASE WHEN c_custkey % 7 = 0 THEN concat('abcde', k4, 'f') WHEN c_custkey % 7 = 1 THEN concat('ABCD', k4, 'F') ELSE concat('ABCDE', k4, 'F') END AS pan,
       CASE WHEN c_custkey % 8 = 0 THEN concat('27aabcu', k4, 'r1zp') ELSE concat('27AABCU', k4, 'R1ZP') END AS gst,
       CASE WHEN c_custkey % 12 = 0 THEN concat('11', k4, '9') ELSE concat('11', k4) END AS pincode,
       CASE WHEN c_custkey % 10 = 0 THEN concat('SBIN1', k4, '00') ELSE concat('SBIN0', k4, '00') END AS ifsc,
       concat('1234 5678 ', k4) AS aadhaar,
       CASE WHEN c_custkey % 14 = 0 THEN concat('DL01', k4) ELSE concat('DL 01 AB ', k4) END AS vehicle,
       CASE WHEN c_custkey % 15 = 0 THEN '18.555' ELSE concat(CAST(c_custkey % 100 AS STRING), '.5%') END AS tax_rate,
       CASE WHEN c_custkey % 3 = 0 THEN concat('$', k4, '.50') ELSE '1,234.56' END AS amount,
       CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'n.a.' ELSE concat('10.0.', CAST(c_custkey % 256 AS STRING), '.7') END AS host
FROM (SELECT c_custkey, CAST(c_custkey AS STRING) AS k, lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS k4,
             concat('9', lpad(CAST(c_custkey AS STRING), 9, '0')) AS m FROM {customer}) t
""",
    "dup_events": """
SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM {events}
UNION ALL
SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM {events} WHERE event_id % 10 = 0
""",
    "raw_sheet": """
SELECT 0 AS row_id, ' ' AS c0, CAST(NULL AS STRING) AS c1, '' AS c2, '' AS c3, CAST(NULL AS STRING) AS c4
UNION ALL SELECT 1, 'Name', 'Key', 'Key', '', ''
UNION ALL SELECT CAST(2 + s_suppkey AS INT), s_name, CAST(s_suppkey AS STRING),
                 CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST(s_nationkey AS STRING) END, '  ',
                 CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS STRING) FROM {supplier}
""",
    "mixed_small": """
SELECT n_nationkey AS row_id,
       CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey * 10 AS STRING)
            WHEN n_nationkey % 3 = 1 THEN concat('2024-01-', lpad(CAST(n_nationkey % 28 + 1 AS STRING), 2, '0'))
            ELSE n_name END AS mixed,
       n_name AS plain
FROM {nation}
""",
    "outlier_lines": """
SELECT l_orderkey * 10 + l_linenumber AS row_id,
       CASE WHEN (l_orderkey + l_linenumber) % 9 < 2 THEN l_quantity * 1000 + 100000 ELSE l_quantity END AS qty,
       l_discount AS discount
FROM {lineitem}
""",
    "ai_calls": """
SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'b' ELSE 'a' END AS provider,
       CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS input_tokens,
       CASE WHEN role = 'user' THEN 0 ELSE length(text) END AS output_tokens
FROM {conversations}
""",
    "stored_objects": """
SELECT concat('Book_', CAST(p_partkey % 50 AS STRING), '/Sheet_', CAST(p_size AS STRING), '/',
              CASE WHEN p_partkey % 3 = 0 THEN 'uploads' WHEN p_partkey % 3 = 1 THEN 'cleaned' ELSE 'metadata' END,
              '/', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 3 = 2 THEN '.json' ELSE '.xlsx' END) AS path,
       p_partkey * 100 AS length
FROM {part}
""",
}

DATA_COLUMNS = {
    "dirty_orders": "cust_id priority order_date total_amount value_text origin spare".split(),
    "contacts": "phone email pan gst pincode ifsc aadhaar vehicle tax_rate amount host".split(),
    "dup_events": "event_id user_id event_type value".split(),
    "raw_sheet": "c0 c1 c2 c3 c4".split(),
    "mixed_small": "mixed plain".split(),
    "outlier_lines": "qty discount".split(),
}
