"""Format detection, violations, repair and flags.

Detection looks at a bounded sample and is decided once on the driver (one row per
column); everything over the full table is then a projection or one wide aggregate
with exactly one pattern per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from gridwash.functions import cells, formats, rules
from gridwash.operators.profile import content_format, per_column
from gridwash.operators.sampling import data_columns, sampled


def _text(df: DataFrame, c: str) -> Column:
    return cells.safe_str(c, df.schema[c].dataType)


def format_by_name(df: DataFrame, order_by=(), word_match: bool = False) -> DataFrame:
    """column, format: from the column names alone."""
    rows = [
        (c, formats.detect_format_by_name(c, word_match)) for c in data_columns(df, order_by)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, format string")


def format_by_content(df: DataFrame, order_by, columns=None) -> DataFrame:
    """column, format: from the first 20 non-null values; null when no rule fires."""
    cols = list(columns if columns is not None else data_columns(df, order_by))
    return sampled(df, cols, order_by, rules.CONTENT_SAMPLE, [content_format(F.lit(True)).alias("format")])


def detected_formats(df: DataFrame, order_by, word_match: bool = False) -> dict[str, str]:
    """{column: format}, name hints first, then content. Columns without one are absent."""
    cols = data_columns(df, order_by)
    out = {c: formats.detect_format_by_name(c, word_match) for c in cols}
    unnamed = [c for c in cols if out[c] is None]
    if unnamed:
        rows = format_by_content(df, order_by, unnamed).collect()
        out.update({r["column"]: r["format"] for r in rows})
    return {c: out[c] for c in cols if out[c]}


def column_formats(df: DataFrame, order_by, word_match: bool = False) -> DataFrame:
    """column, format for every column; null when none was detected."""
    found = detected_formats(df, order_by, word_match)
    rows = [(c, found.get(c)) for c in data_columns(df, order_by)]
    return df.sparkSession.createDataFrame(rows, "column string, format string")


def format_violations(df: DataFrame, order_by, found: dict | None = None) -> DataFrame:
    """(order columns, column, format, value): one row per violating cell, no shuffle."""
    found = detected_formats(df, order_by) if found is None else found
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    bad = [
        F.when(
            ~formats.is_valid(_text(df, c), fmt),
            F.struct(
                F.lit(c).alias("column"),
                F.lit(fmt).alias("format"),
                _text(df, c).alias("value"),
            ),
        )
        for c, fmt in found.items()
    ]
    if not bad:
        fields = T.StructType([df.schema[k] for k in keys])
        for name in ("column", "format", "value"):
            fields = fields.add(name, T.StringType())
        return df.sparkSession.createDataFrame([], fields)
    return df.select(
        *[cells.column(k) for k in keys], F.inline(F.array_compact(F.array(*bad)))
    )


def violation_summary(df: DataFrame, order_by, found: dict | None = None) -> DataFrame:
    """column, format, description, violations, non_null for violating columns."""
    found = detected_formats(df, order_by) if found is None else found
    if not found:
        return df.sparkSession.createDataFrame(
            [],
            "column string, format string, description string, violations bigint, non_null bigint",
        )
    counted = per_column(
        df,
        found,
        {
            "format": lambda c: F.first(F.lit(found[c])),
            "description": lambda c: F.first(F.lit(rules.FORMATS[found[c]][1])),
            "violations": lambda c: F.count_if(~formats.is_valid(_text(df, c), found[c])),
            "non_null": lambda c: F.count_if(_text(df, c).isNotNull()),
        },
    )
    return counted.where("violations > 0")


def _repaired(df: DataFrame, found: dict) -> tuple[dict, dict, dict]:
    new, invalid, fixed = {}, {}, {}
    for c, fmt in found.items():
        # Only text can take a rewritten value; a typed column keeps its type.
        if not isinstance(df.schema[c].dataType, T.StringType):
            continue
        col = cells.column(c)
        standard = formats.standardize_value(col, fmt)
        wrong = ~formats.is_valid(col, fmt)
        good = wrong & formats.is_valid(standard, fmt)
        new[c] = F.when(good, standard).otherwise(col)
        invalid[c], fixed[c] = wrong, good
    return new, invalid, fixed


def auto_standardize(df: DataFrame, order_by, found: dict | None = None) -> DataFrame:
    """Replace invalid cells by their standard form where that form is valid."""
    found = detected_formats(df, order_by) if found is None else found
    return df.withColumns(_repaired(df, found)[0])


def observed_standardize(df: DataFrame, order_by, found: dict | None = None):
    """The repaired table and an Observation that counts repairs while it is written."""
    found = detected_formats(df, order_by) if found is None else found
    new, invalid, fixed = _repaired(df, found)
    if not new:
        return df, None
    watch = Observation()
    metrics = [F.count_if(invalid[c]).alias(f"invalid:{c}") for c in new]
    metrics += [F.count_if(fixed[c]).alias(f"standardized:{c}") for c in new]
    return df.observe(watch, *metrics).withColumns(new), watch


def standardize_counts(df: DataFrame, order_by, found: dict | None = None) -> DataFrame:
    """column, format, standardized, invalid, message for repaired columns."""
    found = detected_formats(df, order_by) if found is None else found
    new, invalid, fixed = _repaired(df, found)
    schema = "column string, format string, standardized bigint, invalid bigint, message string"
    if not new:
        return df.sparkSession.createDataFrame([], schema)
    counted = per_column(
        df,
        new,
        {
            "format": lambda c: F.first(F.lit(found[c])),
            "description": lambda c: F.first(F.lit(rules.FORMATS[found[c]][1])),
            "standardized": lambda c: F.count_if(fixed[c]),
            "invalid": lambda c: F.count_if(invalid[c]),
        },
    )
    return counted.where("standardized > 0").select(
        "column",
        "format",
        "standardized",
        "invalid",
        F.format_string(
            "Column '%s': Standardized %d/%d values to %s format",
            "column",
            "standardized",
            "invalid",
            "description",
        ).alias("message"),
    )


def pattern_by_content(df: DataFrame, order_by, columns=None) -> DataFrame:
    """column, pattern, match_rate: best of the identifier patterns on the first 100
    values; rate must exceed 0.6, ties keep the earlier pattern. Null when none fits."""
    cols = list(columns if columns is not None else data_columns(df, order_by))
    value = cells.trim_text("value")
    rated = [
        F.struct(
            (F.count_if(value.rlike("(?i)" + p[0])) / F.count("*")).alias("rate"),
            F.lit(-i).alias("place"),
            F.lit(n).alias("name"),
        )
        for i, (n, p) in enumerate(rules.PATTERNS.items())
    ]
    best = sampled(df, cols, order_by, rules.PATTERN_SAMPLE, [F.array_max(F.array(*rated)).alias("best")])
    fits = F.col("best.rate") > rules.PATTERN_SHARE
    return best.select(
        "column",
        F.when(fits, F.col("best.name")).alias("pattern"),
        F.when(fits, F.col("best.rate")).alias("match_rate"),
    )


def detected_patterns(df: DataFrame, order_by, columns=None) -> dict[str, str]:
    rows = pattern_by_content(df, order_by, columns).where("pattern IS NOT NULL").collect()
    found = {r["column"]: r["pattern"] for r in rows}
    return {c: found[c] for c in data_columns(df, order_by) if c in found}


def pattern_mismatches(df: DataFrame, order_by, found: dict) -> DataFrame:
    """(order columns, column, pattern, value): one row per mismatching cell, no shuffle."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    bad = [
        F.when(
            ~formats.matches_pattern(_text(df, c), name),
            F.struct(
                F.lit(c).alias("column"), F.lit(name).alias("pattern"), _text(df, c).alias("value")
            ),
        )
        for c, name in found.items()
    ]
    if not bad:
        fields = T.StructType([df.schema[k] for k in keys])
        for name in ("column", "pattern", "value"):
            fields = fields.add(name, T.StringType())
        return df.sparkSession.createDataFrame([], fields)
    return df.select(*[cells.column(k) for k in keys], F.inline(F.array_compact(F.array(*bad))))


def _mismatch_samples(df: DataFrame, order_by, found: dict, k: int) -> DataFrame:
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    first = Window.partitionBy("column").orderBy(*[cells.column(x) for x in keys], "value")
    top = (
        pattern_mismatches(df, order_by, found)
        .withColumn("pos", F.row_number().over(first))
        .where(F.col("pos") <= k)
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return top.groupBy("column").agg(F.transform(ordered, lambda s: s["value"]).alias("samples"))


def pattern_report(
    df: DataFrame, order_by, columns=None, found: dict | None = None
) -> DataFrame:
    """Full-column totals of the detected pattern, with up to 10 mismatching samples.

    column, pattern, description, total_values, matching_values, mismatched_values,
    match_percentage, samples. Row ids are in :func:`pattern_mismatches`.
    """
    found = detected_patterns(df, order_by, columns) if found is None else found
    schema = (
        "column string, pattern string, description string, total_values bigint, "
        "matching_values bigint, mismatched_values bigint, match_percentage double, "
        "samples array<string>"
    )
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    counted = per_column(
        df,
        found,
        {
            "pattern": lambda c: F.first(F.lit(found[c])),
            "description": lambda c: F.first(F.lit(rules.PATTERNS[found[c]][1])),
            "total_values": lambda c: F.count(cells.column(c)),
            "matching_values": lambda c: F.count_if(
                formats.matches_pattern(_text(df, c), found[c])
            ),
        },
    )
    samples = _mismatch_samples(df, order_by, found, rules.MISMATCH_SAMPLES)
    return counted.join(samples, "column", "left").select(
        "column",
        "pattern",
        "description",
        "total_values",
        "matching_values",
        (F.col("total_values") - F.col("matching_values")).alias("mismatched_values"),
        F.try_divide(F.col("matching_values") * 100.0, F.col("total_values")).alias(
            "match_percentage"
        ),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
    )


analyze_table = pattern_report


def validate_column(df: DataFrame, column: str, pattern: str, order_by) -> DataFrame:
    """One record: totals of one column against one named pattern.

    An unknown pattern yields ``error``; an all-null column is valid.
    """
    known = pattern in rules.PATTERNS
    if not known:
        return df.sparkSession.range(1).select(
            F.lit(column).alias("column"),
            F.lit(pattern).alias("pattern"),
            F.lit(False).alias("valid"),
            F.lit(f"Unknown format: {pattern}").alias("error"),
        )
    ok = formats.matches_pattern(_text(df, column), pattern)
    counted = df.agg(
        F.count(cells.column(column)).alias("total_values"), F.count_if(ok).alias("valid_values")
    )
    samples = _mismatch_samples(df, order_by, {column: pattern}, rules.MISMATCH_SAMPLES)
    total, valid = F.col("total_values"), F.col("valid_values")
    return (
        counted.withColumn("column", F.lit(column))
        .join(samples, "column", "left")
        .select(
            "column",
            F.lit(pattern).alias("pattern"),
            F.lit(rules.PATTERNS[pattern][1]).alias("description"),
            "total_values",
            "valid_values",
            (total - valid).alias("invalid_values"),
            F.try_divide(valid * 100.0, total).alias("validity_percentage"),
            F.coalesce("samples", F.array().cast("array<string>")).alias("invalid_samples"),
            (total == valid).alias("valid"),
            F.when(total == 0, "No values to validate (all null)").alias("message"),
        )
    )


def format_flags(df: DataFrame, order_by, found: dict | None = None) -> DataFrame:
    """FORMAT_MISMATCH rows with severity, samples and a recommendation."""
    report = pattern_report(df, order_by, found=found).where("mismatched_values > 0")
    return report.select(
        "column",
        F.lit("FORMAT_MISMATCH").alias("issue_type"),
        F.when(F.col("match_percentage") < 80, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.col("pattern").alias("format_detected"),
        F.col("description").alias("format_description"),
        "total_values",
        F.col("mismatched_values").alias("mismatched_count"),
        F.round("match_percentage", 2).alias("match_percentage"),
        F.slice("samples", 1, 5).alias("sample_mismatches"),
        F.format_string(
            rules.MISMATCH_TEXT,
            "column",
            "description",
            "mismatched_values",
        ).alias("recommendation"),
    )


def mark_violations(df: DataFrame, order_by=(), found: dict | None = None) -> DataFrame:
    """The table plus ``{column}__ok`` for each column with a detected format."""
    found = detected_formats(df, order_by) if found is None else found
    return df.withColumns(
        {f"{c}__ok": formats.is_valid(_text(df, c), fmt) for c, fmt in found.items()}
    )


def flagged_names(flags: dict[str, tuple[str, int]]) -> dict[str, str]:
    """{column: label} from {column: (pattern, mismatches)}."""
    out = {}
    for c, (pattern, n) in flags.items():
        label = pattern.replace("_", " ").upper()
        out[c] = f"{c} [🚨 {n} format errors]" if "GST" in label else f"{c} [🚨 {label}: {n} errors]"
    return out


def label_headers(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Rename flagged columns so that the header shows the error count."""
    rows = flags.select("column", "format_detected", "mismatched_count").collect()
    return df.withColumnsRenamed(flagged_names({r[0]: (r[1], r[2]) for r in rows}))

