"""Quality score: seven dimensions, 0 to 100.

``measure`` gathers one row of measures per table. The scoring rules are Column
expressions over those measures, so one table or a fleet of tables (one row each)
is scored by the same projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridwash.functions import cells, formats, rules
from gridwash.operators.profile import TableFacts, iqr_bounds, missing_overall, type_kind
from gridwash.operators.quantiles import number
from gridwash.operators.sampling import data_columns

DIMENSIONS = tuple(rules.WEIGHTS)


def generic_header(name: str) -> bool:
    """Score rule for a generic column name."""
    return "Unnamed" in name or "Column_" in name or name.strip() == ""


def measure(
    df: DataFrame, order_by, header_detected: bool = False, with_memory: bool = True, known: TableFacts | None = None
) -> DataFrame:
    """One row with everything the seven dimensions need.

    Passes over the table: one wide aggregate (counts, gaps, single values, size), one
    bounded sample, one pass or a few for quartiles when there are numeric columns, one
    wide aggregate (violations and outliers, now that formats and bounds are known),
    and one row grouping for repeats. What ``known`` holds is not measured again.
    """
    known = known or TableFacts(df, order_by, with_memory)
    cols, types, missing, filled = known.columns, known.types, known.missing, known.values
    kinds = {c: type_kind(types[c]) for c in cols}
    numeric = [c for c in cols if kinds[c] == "numeric"]
    zero = F.lit(0).cast("long")
    n_rows, facts = known.rows, known.sample
    formats_found = {
        c: formats.detect_format_by_name(c) or (facts[c]["content_format"] if c in facts else None)
        for c in cols
    }
    mixed = sum(
        _severely_mixed(facts[c], filled[c]) for c in cols if kinds[c] == "text" and c in facts
    )
    bounds = iqr_bounds(df, [c for c in numeric if filled[c] > 1], rules.SCORE_OUTLIER_IQR)
    checked = [c for c in cols if formats_found[c]]
    second = df.agg(
        F.count("*").alias("n_rows"),
        *[
            F.count_if(
                ~formats.is_valid(cells.safe_str(c, types[c]), formats_found[c])
            ).alias(f"_v{i}")
            for i, c in enumerate(checked)
        ],
        *[
            (F.count_if((number(c) < F.lit(low)) | (number(c) > F.lit(high))) / F.lit(filled[c])).alias(
                f"_o{i}"
            )
            for i, (c, (low, high)) in enumerate(bounds.items())
        ],
    )
    broken = [F.col(f"_v{i}") for i in range(len(checked))]
    ratios = [F.col(f"_o{i}") for i in range(len(bounds))]
    given = {
        "n_cols": len(cols),
        "empty_rows": known.empty_rows,
        "empty_cols": sum(n == n_rows for n in missing.values()),
        "missing_cells": sum(missing.values()),
        "single_value_cols": sum(map(bool, known.single.values())),
        "severe_mixed_cols": mixed,
        "generic_cols": sum(generic_header(c) for c in cols),
        "logical_bytes": known.logical_bytes if with_memory else 0,
        "duplicate_rows": known.repeats,
        **{f"{k}_cols": list(kinds.values()).count(k) for k in ("numeric", "text", "datetime")},
    }
    return second.select(
        "n_rows",
        sum(broken, zero).alias("violations"),
        sum(
            (F.when(v > 0, filled[c]).otherwise(0) for v, c in zip(broken, checked)), zero
        ).alias("violating_column_cells"),
        sum(
            (F.when(r > 0.2, F.least(r * 20, F.lit(10.0))).otherwise(0.0) for r in ratios),
            F.lit(0.0),
        ).alias("outlier_penalty"),
        *[F.lit(v).cast("long").alias(k) for k, v in given.items()],
        F.lit(header_detected).alias("header_detected"),
    )


def _severely_mixed(fact, non_null: int) -> bool:
    parts = [fact["n_number"], fact["n_date"], fact["n_text"]]
    return non_null > 1 and all(p > 0 and p > non_null * 0.2 for p in parts)


def _empty() -> Column:
    return (F.col("n_rows") == 0) | (F.col("n_cols") == 0)


def structural_integrity() -> Column:
    rows, cols = F.col("n_rows"), F.col("n_cols")

    def share(part, whole):
        return (
            F.when(F.col(part) > whole * 0.5, 20.0).when(F.col(part) > whole * 0.3, 5.0).otherwise(0.0)
        )

    penalty = (
        F.when(rows < 1, 50.0).when(rows < 3, 15.0).otherwise(0.0)
        + F.when(cols < 1, 50.0).when(cols > 100, 10.0).otherwise(0.0)
        + share("empty_rows", rows)
        + share("empty_cols", cols)
    )
    return F.greatest(F.lit(0.0), 100.0 - penalty)


def data_completeness() -> Column:
    ratio = F.try_divide(F.col("missing_cells").cast("double"), F.col("n_rows") * F.col("n_cols"))
    base = F.greatest(F.lit(0.0), 100.0 - ratio * 100.0)
    return F.when(_empty(), 0.0).otherwise(
        F.when(ratio < 0.9, F.greatest(base, F.lit(40.0))).otherwise(base)
    )


def data_consistency() -> Column:
    share = F.try_divide(F.col("severe_mixed_cols").cast("double"), F.col("n_cols"))
    return F.when(_empty(), 50.0).otherwise(F.greatest(F.lit(50.0), 85.0 - share * 20.0))


def data_uniqueness() -> Column:
    ratio = F.try_divide(F.col("duplicate_rows").cast("double"), F.col("n_rows"))
    repeats = (
        F.when(F.col("n_rows") <= 1, 0.0)
        .when(ratio > 0.7, ratio * 30.0)
        .when(ratio > 0.5, ratio * 15.0)
        .otherwise(0.0)
    )
    single = F.when(F.col("single_value_cols") > F.col("n_cols") * 0.5, 20.0).otherwise(0.0)
    return F.when(_empty(), 50.0).otherwise(F.greatest(F.lit(50.0), 90.0 - repeats - single))


def format_compliance() -> Column:
    ratio = F.try_divide(F.col("violations").cast("double"), F.col("violating_column_cells"))
    return (
        F.when(_empty(), 70.0)
        .when(F.col("violations") == 0, 100.0)
        .when(F.col("violating_column_cells") == 0, 70.0)
        .otherwise(F.greatest(F.lit(40.0), 100.0 - ratio * 60.0))
    )


def business_logic() -> Column:
    return F.when(_empty() | (F.col("n_rows") < 2), 75.0).otherwise(
        F.greatest(F.lit(60.0), 90.0 - F.col("outlier_penalty"))
    )


def header_quality() -> Column:
    ratio = F.coalesce(
        F.try_divide(F.col("generic_cols").cast("double"), F.col("n_cols")), F.lit(0.0)
    )
    generic = F.when(ratio > 0.5, ratio * 30.0).when(ratio > 0.3, ratio * 15.0).otherwise(0.0)
    missing = F.when(F.col("header_detected"), 0.0).otherwise(15.0)
    return F.greatest(F.lit(50.0), 85.0 - missing - generic)


RULES = {
    "structural_integrity": structural_integrity,
    "data_completeness": data_completeness,
    "data_consistency": data_consistency,
    "data_uniqueness": data_uniqueness,
    "format_compliance": format_compliance,
    "business_logic": business_logic,
    "header_quality": header_quality,
}


def dimension_scores(measures: DataFrame) -> DataFrame:
    """The measures plus one score column per dimension."""
    return measures.withColumns({name: rule() for name, rule in RULES.items()})


def total_score() -> Column:
    """Weighted sum of the dimension columns in dimension order, truncated."""
    weighted = sum((F.col(d) * w for d, w in rules.WEIGHTS.items()), F.lit(0.0))
    return F.floor(weighted).cast("int")


def _level(score: Column, i: int) -> Column:
    out = F.lit(rules.LEVELS[-1][i])
    for level in reversed(rules.LEVELS[:-1]):
        out = F.when(score < level[0], F.lit(level[i])).otherwise(out)
    return out


def quality_level(score: Column) -> Column:
    return _level(score, 1)


def recommendation(score: Column) -> Column:
    return _level(score, 2)


def _messages(table, thresholds: dict | None) -> Column:
    limits = thresholds or {}
    return F.array_compact(
        F.array(
            *[
                F.when(F.col(d) < limits.get(d, limit), F.lit(text)).otherwise(F.lit(None))
                for d, limit, text in table
            ]
        )
    )


def score_issues(thresholds: dict | None = None) -> Column:
    return _messages(rules.ISSUES, thresholds)


def score_suggestions(thresholds: dict | None = None) -> Column:
    return _messages(rules.SUGGESTIONS, thresholds)


def score_stats() -> Column:
    """Map of formatted statistics."""

    def share(part, whole):
        return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))

    n_cells = F.col("n_rows") * F.col("n_cols")
    stats = F.create_map(
        F.lit("shape"),
        F.format_string("%d rows × %d columns", "n_rows", "n_cols"),
        F.lit("missing_data"),
        F.format_string(
            "%,d/%,d cells (%.1f%%)",
            F.col("missing_cells"),
            n_cells,
            share(F.col("missing_cells"), n_cells),
        ),
        F.lit("duplicate_rows"),
        F.format_string(
            "%,d/%,d rows (%.1f%%)",
            F.col("duplicate_rows"),
            F.col("n_rows"),
            share(F.col("duplicate_rows"), F.col("n_rows")),
        ),
        F.lit("empty_columns"),
        F.format_string("%d/%d columns", "empty_cols", "n_cols"),
        F.lit("data_types"),
        F.format_string(
            "Numeric: %d, Text: %d, DateTime: %d", "numeric_cols", "text_cols", "datetime_cols"
        ),
        F.lit("memory_usage"),
        F.format_string("%.1f MB", F.col("logical_bytes") / F.lit(1048576.0)),
    )
    return F.when(_empty(), F.create_map(F.lit("status"), F.lit("Empty dataset"))).otherwise(stats)


def quality_report(
    df: DataFrame, order_by, header_detected: bool = False, measures: DataFrame | None = None
) -> DataFrame:
    """One record: rows, columns, score, level, issues, suggestions, stats,
    recommendation and the dimension scores."""
    scored = dimension_scores(measures if measures is not None else measure(df, order_by, header_detected))
    score = F.col("score")
    return scored.withColumn("score", total_score()).select(
        F.col("n_rows").alias("rows"),
        F.col("n_cols").alias("columns"),
        "score",
        quality_level(score).alias("quality_level"),
        score_issues().alias("issues"),
        score_suggestions().alias("suggestions"),
        score_stats().alias("stats"),
        recommendation(score).alias("recommendation"),
        F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), F.col(d))]).alias(
            "detailed_scores"
        ),
    )


def calculate_quality_score(df: DataFrame, order_by) -> float:
    """The total alone, as a float."""
    row = dimension_scores(measure(df, order_by, with_memory=False)).select(total_score()).first()
    return float(row[0])


def basic_score(df: DataFrame, order_by=()) -> DataFrame:
    """score = 100 - missing %, with HIGH above 70, MEDIUM above 40, else LOW."""
    score = F.greatest(F.lit(0.0), 100.0 - F.col("missing_percent"))
    return missing_overall(df, order_by).select(
        score.alias("score"),
        F.when(score > 70, "HIGH").when(score > 40, "MEDIUM").otherwise("LOW").alias(
            "quality_level"
        ),
    )


def score_band(score: Column, bands: str = "display") -> Column:
    """Display band of a score; see ``rules.SCORE_BANDS``."""
    table = rules.SCORE_BANDS[bands]
    out = F.lit(table[-1][1])
    for bound, label in reversed(table[:-1]):
        out = F.when(score < bound, F.lit(label)).otherwise(out)
    return out
