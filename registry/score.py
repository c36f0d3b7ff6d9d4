"""Queries of the scoring operators (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwash.functions import rules
from gridwash.operators import profile, score
from registry import sqltext as s
from registry.base import DATA_COLUMNS, query
from registry.profile import _bounds, _mixed

ORDERS = DATA_COLUMNS["dirty_orders"]
TEXTS = [c for c in ORDERS if c != "cust_id"]
ROW = "row_id"
# Formats of the two columns that have one: order_date by name, total_amount by name.
FORMATS = {"order_date": "date", "total_amount": "currency_inr"}


def measures_sql(columns, texts, numerics, formats, header_detected=False, dup=None, bounds_source="f"):
    cols = ", ".join(columns)
    viol = " UNION ALL ".join(
        f"SELECT count(*) FILTER (WHERE NOT {s.valid(c, k)}) AS v, count({c}) AS n FROM f" for c, k in formats.items()
    ) or "SELECT 0 AS v, 0 AS n WHERE false"
    mixed = f"SELECT count(*) FILTER (WHERE severe) AS n FROM ({_mixed(texts)})" if texts else "SELECT 0 AS n"
    if numerics:
        ratios = " UNION ALL ".join(
            f"SELECT count(*) FILTER (WHERE {c} < low OR {c} > high) / count({c}) AS r FROM f, "
            f"(SELECT * FROM ({_bounds([c], 5)}) WHERE high > low)"
            for c in numerics
        )
        penalty = f"SELECT coalesce(sum(CASE WHEN r > 0.2 THEN least(r * 20, 10.0) END), 0.0) AS p FROM ({ratios})"
    else:
        penalty = "SELECT 0.0 AS p"
    return f"""
    shape AS (SELECT count(*) AS n_rows, {len(columns)} AS n_cols,
        count(*) FILTER (WHERE {' AND '.join(f'{c} IS NULL' for c in columns)}) AS empty_rows,
        {' + '.join(f'CAST(count({c}) = 0 AS BIGINT)' for c in columns)} AS empty_cols,
        {' + '.join(f'(count(*) - count({c}))' for c in columns)} AS missing_cells,
        {' + '.join(f'CAST(count(DISTINCT {c}) = 1 AS BIGINT)' for c in columns)} AS single_value_cols,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM f)) AS duplicate_rows FROM f),
    mx AS ({mixed}), vi AS (SELECT coalesce(sum(v), 0) AS violations, coalesce(sum(n), 0) AS cells FROM ({viol}) WHERE v > 0),
    ou AS ({penalty}),
    m AS (SELECT shape.*, mx.n AS severe_mixed_cols, vi.violations, vi.cells AS violating_column_cells, CAST(ou.p AS DOUBLE) AS outlier_penalty FROM shape, mx, vi, ou),
    sc AS (SELECT *,
        CAST(greatest(0, 100 - CASE WHEN n_rows < 1 THEN 50 WHEN n_rows < 3 THEN 15 ELSE 0 END
            - CASE WHEN n_cols < 1 THEN 50 WHEN n_cols > 100 THEN 10 ELSE 0 END
            - CASE WHEN empty_rows > n_rows * 0.5 THEN 20 WHEN empty_rows > n_rows * 0.3 THEN 5 ELSE 0 END
            - CASE WHEN empty_cols > n_cols * 0.5 THEN 20 WHEN empty_cols > n_cols * 0.3 THEN 5 ELSE 0 END) AS DOUBLE) AS structural_integrity,
        CASE WHEN missing_cells::DOUBLE / (n_rows * n_cols) < 0.9
             THEN greatest(100 - missing_cells::DOUBLE / (n_rows * n_cols) * 100, 40::DOUBLE)
             ELSE greatest(0, 100 - missing_cells::DOUBLE / (n_rows * n_cols) * 100) END AS data_completeness,
        greatest(50::DOUBLE, 85 - severe_mixed_cols::DOUBLE / n_cols * 20) AS data_consistency,
        greatest(50::DOUBLE, 90 - CASE WHEN duplicate_rows::DOUBLE / n_rows > 0.7 THEN duplicate_rows::DOUBLE / n_rows * 30
             WHEN duplicate_rows::DOUBLE / n_rows > 0.5 THEN duplicate_rows::DOUBLE / n_rows * 15 ELSE 0 END
             - CASE WHEN single_value_cols > n_cols * 0.5 THEN 20 ELSE 0 END) AS data_uniqueness,
        CASE WHEN violations = 0 THEN 100::DOUBLE ELSE greatest(40::DOUBLE, 100 - violations::DOUBLE / violating_column_cells * 60) END AS format_compliance,
        CASE WHEN n_rows < 2 THEN 75::DOUBLE ELSE greatest(60::DOUBLE, 90 - outlier_penalty) END AS business_logic,
        {85.0 if header_detected else 70.0}::DOUBLE AS header_quality FROM m),
    total AS (SELECT *, CAST(floor(structural_integrity * 0.25::DOUBLE + data_completeness * 0.30::DOUBLE + data_consistency * 0.15::DOUBLE
        + data_uniqueness * 0.10::DOUBLE + format_compliance * 0.05::DOUBLE + business_logic * 0.05::DOUBLE + header_quality * 0.10::DOUBLE) AS INTEGER) AS score FROM sc)
    """


MEASURES = measures_sql(ORDERS, TEXTS, ["cust_id"], FORMATS)
LEVEL = "CASE WHEN score < 25 THEN 'POOR' WHEN score < 45 THEN 'FAIR' WHEN score < 65 THEN 'GOOD' WHEN score < 80 THEN 'VERY_GOOD' ELSE 'EXCELLENT' END"
RECOMMEND = "CASE " + " ".join(
    f"WHEN score < {b} THEN {s.q(t)}" for b, _, t in rules.LEVELS[:-1]
) + f" ELSE {s.q(rules.LEVELS[-1][2])} END"


def _texts(table):
    return "concat_ws('|', " + ", ".join(
        f"CASE WHEN {d} < {b} THEN {s.q(t)} END" for d, b, t in table
    ) + ")"


def _scored(d):
    return score.dimension_scores(score.measure(d.fixture("dirty_orders"), ROW, with_memory=False))


for _i, _name in enumerate(score.DIMENSIONS, start=1):

    @query(
        f"q{_i:02d}_{_name}",
        f"WITH {MEASURES} SELECT round({_name}, 9) AS {_name} FROM total",
        "dirty_orders",
    )
    def dimension(d, name=_name):
        return _scored(d).select(F.round(name, 9).alias(name))


# The same dimensions where their penalties fire.
MIXED = DATA_COLUMNS["mixed_small"]
MIXED_SQL = measures_sql(MIXED, MIXED, [], {})


@query(
    "q03_data_consistency_mixed",
    f"WITH {MIXED_SQL} SELECT round(data_consistency, 9) AS data_consistency, severe_mixed_cols FROM total",
    "mixed_small",
)
def q03_mixed(d):
    out = score.dimension_scores(score.measure(d.fixture("mixed_small"), ROW, with_memory=False))
    return out.select(F.round("data_consistency", 9).alias("data_consistency"), "severe_mixed_cols")


QTY = DATA_COLUMNS["outlier_lines"]


@query(
    "q06_business_logic_outliers",
    f"WITH {measures_sql(QTY, [], QTY, {})} SELECT round(business_logic, 6) AS business_logic FROM total",
    "outlier_lines",
)
def q06_outliers(d):
    out = score.dimension_scores(score.measure(d.fixture("outlier_lines"), ROW, with_memory=False))
    return out.select(F.round("business_logic", 6).alias("business_logic"))


@query("q08_quality_score", f"WITH {MEASURES} SELECT score FROM total", "dirty_orders")
def q08(d):
    return _scored(d).select(score.total_score().alias("score"))


@query(
    "q09_quality_level",
    f"WITH {MEASURES} SELECT score, {LEVEL} AS quality_level, {RECOMMEND} AS recommendation FROM total",
    "dirty_orders",
)
def q09(d):
    out = _scored(d).select(score.total_score().alias("score"))
    return out.select(
        "score",
        score.quality_level(F.col("score")).alias("quality_level"),
        score.recommendation(F.col("score")).alias("recommendation"),
    )


@query("q10_score_issues", f"WITH {MEASURES} SELECT {_texts(rules.ISSUES)} AS issues FROM total", "dirty_orders")
def q10(d):
    return _scored(d).select(F.array_join(score.score_issues(), "|").alias("issues"))


# Tighter limits, so that the lines are seen to appear.
TIGHT = {"structural_integrity": 100, "data_completeness": 90, "data_uniqueness": 95, "header_quality": 86}


@query(
    "q10_score_issues_tight",
    f"WITH {MEASURES} SELECT {_texts([(d, TIGHT.get(d, b), t) for d, b, t in rules.ISSUES])} AS issues FROM total",
    "dirty_orders",
)
def q10_tight(d):
    return _scored(d).select(F.array_join(score.score_issues(TIGHT), "|").alias("issues"))


@query(
    "q11_score_suggestions",
    f"WITH {MEASURES} SELECT {_texts([(d, TIGHT.get(d, b), t) for d, b, t in rules.SUGGESTIONS])} AS suggestions FROM total",
    "dirty_orders",
)
def q11(d):
    return _scored(d).select(F.array_join(score.score_suggestions(TIGHT), "|").alias("suggestions"))


@query(
    "q12_score_stats",
    f"""WITH {MEASURES} SELECT format('{{}} rows × {{}} columns', n_rows, n_cols) AS shape,
    format('{{:,}}/{{:,}} cells ({{:.1f}}%)', missing_cells, n_rows * n_cols, missing_cells * 100.0::DOUBLE / (n_rows * n_cols)) AS missing_data,
    format('{{:,}}/{{:,}} rows ({{:.1f}}%)', duplicate_rows, n_rows, duplicate_rows * 100.0::DOUBLE / n_rows) AS duplicate_rows,
    format('{{}}/{{}} columns', empty_cols, n_cols) AS empty_columns,
    'Numeric: 1, Text: 6, DateTime: 0' AS data_types FROM total""",
    "dirty_orders",
)
def q12(d):
    out = _scored(d).select(score.score_stats().alias("stats"))
    keys = ("shape", "missing_data", "duplicate_rows", "empty_columns", "data_types")
    return out.select(*[F.col("stats")[k].alias(k) for k in keys])


@query(
    "q13_quality_report",
    f"WITH {MEASURES} SELECT n_rows AS rows, n_cols AS columns, score, {LEVEL} AS quality_level, {RECOMMEND} AS recommendation, "
    f"{_texts(rules.ISSUES)} AS issues, {_texts(rules.SUGGESTIONS)} AS suggestions, "
    + ", ".join(f"round({d}, 6) AS {d}" for d in score.DIMENSIONS)
    + " FROM total",
    "dirty_orders",
)
def q13(d):
    out = score.quality_report(d.fixture("dirty_orders"), ROW)
    return out.select(
        "rows",
        "columns",
        "score",
        "quality_level",
        "recommendation",
        F.array_join("issues", "|").alias("issues"),
        F.array_join("suggestions", "|").alias("suggestions"),
        *[F.round(F.col("detailed_scores")[k], 6).alias(k) for k in score.DIMENSIONS],
    )


MISS = " + ".join(f"(count(*) - count({c}))" for c in ORDERS)


@query(
    "q14_basic_score",
    f"SELECT round(sc, 9) AS score, CASE WHEN sc > 70 THEN 'HIGH' WHEN sc > 40 THEN 'MEDIUM' ELSE 'LOW' END AS quality_level "
    f"FROM (SELECT greatest(0, 100 - ({MISS}) * 100.0::DOUBLE / (count(*) * {len(ORDERS)})) AS sc FROM f)",
    "dirty_orders",
)
def q14(d):
    return score.basic_score(d.fixture("dirty_orders"), ROW).withColumn("score", F.round("score", 9))


@query(
    "q15_score_band",
    "SELECT doc_id, CASE WHEN sc < 40 THEN 'low' WHEN sc < 70 THEN 'medium' ELSE 'high' END AS display, "
    "CASE WHEN sc < 60 THEN 'red' WHEN sc < 80 THEN 'yellow' ELSE 'green' END AS colour, "
    "CASE WHEN sc < 30 THEN 'garbage' WHEN sc < 50 THEN 'poor' WHEN sc < 70 THEN 'fair' WHEN sc < 85 THEN 'good' ELSE 'excellent' END AS file "
    "FROM (SELECT doc_id, n_chars % 101 AS sc FROM documents)",
)
def q15(d):
    sc = F.col("n_chars") % 101
    return d.table("documents").select(
        "doc_id", *[score.score_band(sc, b).alias(b) for b in rules.SCORE_BANDS]
    )


@query(
    "a26_before_after",
    f"WITH {MEASURES} SELECT 'before' AS stage, n_rows AS rows, n_cols AS columns, score FROM total "
    "UNION ALL SELECT 'after', n_rows, n_cols, score FROM total",
    "dirty_orders",
)
def a26(d):
    from gridwash.operators import convert

    before = d.fixture("dirty_orders")
    after = convert.trim_all(before, ROW)
    return profile.before_after(
        score.quality_report(before, ROW), score.quality_report(after, ROW)
    )
