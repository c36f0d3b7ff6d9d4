"""Queries of the format operators (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwash.functions import formats, rules
from gridwash.operators import fleet, validation
from registry import sqltext as s
from registry.base import DATA_COLUMNS, query

CONTACTS = DATA_COLUMNS["contacts"]
ORDERS = DATA_COLUMNS["dirty_orders"]
ROW = "row_id"

# What the name words and content rules give for the contacts columns.
CONTACT_FORMATS = {
    "phone": "phone",
    "email": "email",
    "pan": "pan",
    "gst": "gst",
    "pincode": "pincode",
    "ifsc": "ifsc",
    "aadhaar": "aadhaar",
    "vehicle": "vehicle",
    "tax_rate": "percentage",
    "amount": "currency_inr",
}

NAME_CASE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(name), {s.q(w)})" for w in words) + f" THEN {s.q(fmt)}"
    for fmt, words in rules.NAME_WORDS
) + " END"


def _names(columns):
    return "(VALUES " + ", ".join(f"({s.q(c)})" for c in columns) + ") AS t(name)"


def _content(columns):
    return (
        "SELECT \"column\", CASE "
        + " ".join(
            f"WHEN count(*) FILTER (WHERE {hit}) > count(*) * {share} THEN {s.q(fmt)}"
            for fmt, hit, share in (
                ("date", s.has("value", rules.CONTENT_RULES[0][1]), 0.5),
                ("gst", s.has("value", rules.CONTENT_RULES[1][1]), 0.3),
                ("pan", s.has("value", rules.CONTENT_RULES[2][1]), 0.3),
                ("phone", s.has("translate(value, ' -', '')", rules.CONTENT_RULES[3][1]), 0.3),
                ("email", "contains(value, '@') AND contains(value, '.')", 0.3),
            )
        )
        + f" END AS format FROM ({s.sample(columns, 20)}) GROUP BY 1"
    )


@query("v01_format_by_name", f"SELECT name AS \"column\", {NAME_CASE} AS format FROM {_names(CONTACTS)}")
def v01(d):
    return validation.format_by_name(d.fixture("contacts"), ROW)


@query("v02_format_by_content", _content(CONTACTS), "contacts")
def v02(d):
    return validation.format_by_content(d.fixture("contacts"), ROW)


@query("v02_format_by_content_orders", _content(ORDERS), "dirty_orders")
def v02_orders(d):
    return validation.format_by_content(d.fixture("dirty_orders"), ROW)


@query(
    "v03_column_formats",
    f"SELECT name AS \"column\", coalesce({NAME_CASE}, format) AS format FROM {_names(ORDERS)} "
    f"LEFT JOIN ({_content(ORDERS)}) c ON c.\"column\" = name",
    "dirty_orders",
)
def v03(d):
    return validation.column_formats(d.fixture("dirty_orders"), ROW)


@query(
    "v04_is_valid",
    "SELECT row_id, " + ", ".join(f"{s.valid(c, k)} AS {c}" for c, k in CONTACT_FORMATS.items()) + " FROM f",
    "contacts",
)
def v04(d):
    return d.fixture("contacts").select(
        "row_id", *[formats.is_valid(c, k).alias(c) for c, k in CONTACT_FORMATS.items()]
    )


@query(
    "v04_is_valid_date",
    f"SELECT row_id, {s.valid('order_date', 'date')} AS order_date FROM f",
    "dirty_orders",
)
def v04_date(d):
    return d.fixture("dirty_orders").select(
        "row_id", formats.is_valid("order_date", "date").alias("order_date")
    )


@query(
    "v05_format_violations",
    " UNION ALL ".join(
        f"SELECT row_id, {s.q(c)} AS \"column\", {s.q(k)} AS format, {c} AS value FROM f WHERE NOT {s.valid(c, k)}"
        for c, k in CONTACT_FORMATS.items()
    ),
    "contacts",
)
def v05(d):
    return validation.format_violations(d.fixture("contacts"), ROW)


@query(
    "v06_violation_summary",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT {s.q(c)} AS \"column\", {s.q(k)} AS format, {s.q(rules.FORMATS[k][1])} AS description, "
        f"count(*) FILTER (WHERE NOT {s.valid(c, k)}) AS violations, count({c}) AS non_null FROM f"
        for c, k in CONTACT_FORMATS.items()
    )
    + ") WHERE violations > 0",
    "contacts",
)
def v06(d):
    return validation.violation_summary(d.fixture("contacts"), ROW)


def _repair(c, k):
    return f"CASE WHEN NOT {s.valid(c, k)} AND {s.valid('(' + s.standard(c, k) + ')', k)} THEN {s.standard(c, k)} ELSE {c} END"


@query(
    "v07_auto_standardize",
    "SELECT row_id, host, " + ", ".join(f"{_repair(c, k)} AS {c}" for c, k in CONTACT_FORMATS.items()) + " FROM f",
    "contacts",
)
def v07(d):
    return validation.auto_standardize(d.fixture("contacts"), ROW)


@query(
    "v07_standardize_counts",
    "SELECT *, format('Column ''{}'': Standardized {}/{} values to {} format', \"column\", standardized, invalid, description) AS message FROM ("
    + " UNION ALL ".join(
        f"SELECT {s.q(c)} AS \"column\", {s.q(k)} AS format, {s.q(rules.FORMATS[k][1])} AS description, "
        f"count(*) FILTER (WHERE NOT {s.valid(c, k)} AND {s.valid('(' + s.standard(c, k) + ')', k)}) AS standardized, "
        f"count(*) FILTER (WHERE NOT {s.valid(c, k)}) AS invalid FROM f"
        for c, k in CONTACT_FORMATS.items()
    )
    + ") WHERE standardized > 0",
    "contacts",
)
def v07_counts(d):
    df = d.fixture("contacts")
    out = validation.standardize_counts(df, ROW)
    description = F.create_map(
        *[x for k, v in rules.FORMATS.items() for x in (F.lit(k), F.lit(v[1]))]
    )
    return out.withColumn("description", description[F.col("format")])


RATES = ", ".join(
    f"count(*) FILTER (WHERE {s.matches('value', p)}) / count(*) AS \"{p}\"" for p in rules.PATTERNS
)
BEST = "greatest(" + ", ".join(f'"{p}"' for p in rules.PATTERNS) + ")"
PICK = "CASE " + " ".join(f"WHEN \"{p}\" = {BEST} THEN '{p}'" for p in rules.PATTERNS) + " END"


def _patterns(columns):
    return (
        f"SELECT \"column\", CASE WHEN {BEST} > 0.6 THEN {PICK} END AS pattern, CASE WHEN {BEST} > 0.6 THEN {BEST} END AS match_rate "
        f"FROM (SELECT \"column\", {RATES} FROM ({s.sample(columns, 100)}) GROUP BY 1)"
    )


@query("v08_pattern_by_content", _patterns(CONTACTS), "contacts")
def v08(d):
    return validation.pattern_by_content(d.fixture("contacts"), ROW)


MATCH_CASE = "CASE pattern " + " ".join(
    f"WHEN '{p}' THEN {s.matches('value', p)}" for p in rules.PATTERNS
) + " END"
DESCRIPTION = "CASE pattern " + " ".join(
    f"WHEN '{p}' THEN {s.q(v[1])}" for p, v in rules.PATTERNS.items()
) + " END"


def _report(columns):
    return (
        f"SELECT \"column\", pattern, {DESCRIPTION} AS description, count(*) AS total_values, "
        "count(*) FILTER (WHERE hit) AS matching_values, count(*) FILTER (WHERE NOT hit) AS mismatched_values, "
        "count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*) AS match_percentage, "
        "coalesce(string_agg(value, '|' ORDER BY row_id) FILTER (WHERE NOT hit AND miss_no <= 10), '') AS samples "
        "FROM (SELECT *, row_number() OVER (PARTITION BY \"column\", hit ORDER BY row_id) AS miss_no FROM "
        f"(SELECT v.*, pattern, {MATCH_CASE} AS hit FROM ({s.cells(columns)}) v JOIN ({_patterns(columns)}) p "
        "ON p.\"column\" = v.\"column\" WHERE pattern IS NOT NULL)) GROUP BY ALL"
    )


@query("v09_pattern_report", _report(CONTACTS), "contacts")
def v09(d):
    out = validation.pattern_report(d.fixture("contacts"), ROW)
    return out.withColumn("samples", F.array_join("samples", "|"))


@query(
    "v09_pattern_mismatches",
    f"SELECT row_id, \"column\", pattern, value FROM (SELECT v.*, pattern, {MATCH_CASE} AS hit FROM ({s.cells(CONTACTS)}) v "
    f"JOIN ({_patterns(CONTACTS)}) p ON p.\"column\" = v.\"column\" WHERE pattern IS NOT NULL) WHERE NOT hit",
    "contacts",
)
def v09_cells(d):
    df = d.fixture("contacts")
    return validation.pattern_mismatches(df, ROW, validation.detected_patterns(df, ROW))


@query(
    "v10_validate_column",
    f"SELECT 'host' AS \"column\", 'IPV4' AS pattern, 'IPv4 Address' AS description, count(host) AS total_values, "
    f"count(*) FILTER (WHERE {s.matches('host', 'IPV4')}) AS valid_values, "
    f"count(*) FILTER (WHERE NOT {s.matches('host', 'IPV4')}) AS invalid_values, "
    f"count(*) FILTER (WHERE {s.matches('host', 'IPV4')}) * 100.0::DOUBLE / count(host) AS validity_percentage, "
    f"(SELECT string_agg(host, '|' ORDER BY row_id) FROM (SELECT * FROM f WHERE NOT {s.matches('host', 'IPV4')} ORDER BY row_id LIMIT 10)) AS invalid_samples, "
    f"bool_and({s.matches('host', 'IPV4')}) AS valid, CAST(NULL AS VARCHAR) AS message FROM f",
    "contacts",
)
def v10(d):
    out = validation.validate_column(d.fixture("contacts"), "host", "IPV4", ROW)
    return out.withColumn("invalid_samples", F.array_join("invalid_samples", "|"))


@query("v11_analyze_table", _report(ORDERS), "dirty_orders")
def v11(d):
    out = validation.analyze_table(d.fixture("dirty_orders"), ROW)
    return out.withColumn("samples", F.array_join("samples", "|"))


def _flags(columns):
    return (
        "SELECT \"column\", 'FORMAT_MISMATCH' AS issue_type, CASE WHEN match_percentage < 80 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, "
        "pattern AS format_detected, description AS format_description, total_values, mismatched_values AS mismatched_count, "
        "round(match_percentage, 2) AS match_percentage, array_to_string(string_split(samples, '|')[1:5], '|') AS sample_mismatches, "
        "format('Column ''{}'' appears to contain {} but {} values don''t match the expected format. Review these values for data entry errors.', "
        f"\"column\", description, mismatched_values) AS recommendation FROM ({_report(columns)}) WHERE mismatched_values > 0"
    )


@query("v12_format_flags", _flags(CONTACTS), "contacts")
def v12(d):
    out = validation.format_flags(d.fixture("contacts"), ROW)
    return out.withColumn("sample_mismatches", F.array_join("sample_mismatches", "|"))


@query(
    "v13_mark_violations",
    "SELECT *, " + ", ".join(f"{s.valid(c, k)} AS {c}__ok" for c, k in CONTACT_FORMATS.items()) + " FROM f",
    "contacts",
)
def v13(d):
    return validation.mark_violations(d.fixture("contacts"), ROW)


@query(
    "v14_label_headers",
    "SELECT \"column\", CASE WHEN contains(pattern, 'GST') THEN format('{} [🚨 {} format errors]', \"column\", mismatched_values) "
    "ELSE format('{} [🚨 {}: {} errors]', \"column\", upper(replace(pattern, '_', ' ')), mismatched_values) END AS label "
    f"FROM ({_report(CONTACTS)}) WHERE mismatched_values > 0",
    "contacts",
)
def v14(d):
    df = d.fixture("contacts")
    flags = validation.format_flags(df, ROW)
    labelled = validation.label_headers(df, flags)
    pairs = [(a, b) for a, b in zip(df.columns, labelled.columns) if a != b]
    return d.spark.createDataFrame(pairs, "column string, label string")


# A fleet of tables in one: three datasets of two sheets; one sheet has no name.
FLEET = "SELECT *, concat('set', CAST(row_id % 3 AS STRING)) AS dataset, CASE WHEN row_id % 2 = 0 THEN 'even' END AS sheet FROM "


def _fleet_column(c):
    k = CONTACT_FORMATS.get(c)
    checked = f"({c} IS NOT NULL AND {s.trim(c)} <> '')" if k else "false"
    bad = f"{checked} AND NOT {s.valid(c, k)}" if k else "false"
    return (
        f"SELECT dataset, sheet, '{c}' AS \"column\", {s.q(k) if k else 'CAST(NULL AS VARCHAR)'} AS format, "
        f"{c} IS NULL AS gap, {checked} AS checked, {bad} AS bad FROM fleet"
    )


@query(
    "v06_fleet_report",
    f"WITH fleet AS ({FLEET} f), cells AS (" + " UNION ALL ".join(map(_fleet_column, CONTACTS)) + ") "
    "SELECT dataset, sheet, \"column\", format, CASE GROUPING_ID(dataset, sheet, \"column\", format) WHEN 0 THEN 'format' WHEN 1 THEN 'column' "
    "WHEN 3 THEN 'sheet' WHEN 7 THEN 'dataset' ELSE 'all' END AS level, count(*) AS cells, count(*) FILTER (WHERE gap) AS missing, "
    "count(*) FILTER (WHERE gap) * 100.0::DOUBLE / count(*) AS missing_percent, count(*) FILTER (WHERE checked) AS checked, "
    "count(*) FILTER (WHERE bad) AS violations FROM cells GROUP BY ROLLUP (dataset, sheet, \"column\", format)",
    "contacts",
)
def v06_fleet(d):
    tables = d.spark.sql(FLEET + "{f}", f=d.fixture("contacts"))
    return fleet.fleet_report(tables, order_by=ROW, found=CONTACT_FORMATS)
