"""Number operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridwash.functions import cells, rules
from gridwash.operators.profile import iqr_bounds
from gridwash.operators.sampling import numeric_columns


def fix_negative(c) -> Column:
    """``(1,234)`` and ``1,234-`` become ``-1,234``; other text stays."""
    text = cells.trim_text(c)
    wrapped = r"^\(\s*([\d.,]+)\s*\)$"
    trailing = r"^([\d.,]+)\s*-$"
    return (
        F.when(text.rlike(wrapped), F.regexp_replace(text, wrapped, "-$1"))
        .when(text.rlike(trailing), F.regexp_replace(text, trailing, "-$1"))
        .otherwise(cells.column(c))
    )


def standard_separators(c) -> Column:
    """Numbers in either style (1,234.56 or 1.234,56) as plain 1234.56 text."""
    text = cells.trim_text(c)
    comma_decimal = text.rlike(r"^[+-]?\d{1,3}(\.\d{3})+(,\d+)?$") & (
        text.contains(",") | text.rlike(r"^[+-]?\d{1,3}(\.\d{3}){2,}$")
    )
    comma_decimal = comma_decimal | text.rlike(r"^[+-]?\d+,\d{1,2}$")
    point_decimal = text.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$")
    return (
        F.when(comma_decimal, F.translate(F.translate(text, ".", ""), ",", "."))
        .when(point_decimal, F.translate(text, ",", ""))
        .otherwise(cells.column(c))
    )


def round_all(df: DataFrame, digits: int = 2, columns=None, order_by=()) -> DataFrame:
    """Round numeric columns to one number of decimals."""
    cols = columns or numeric_columns(df, order_by)
    return df.withColumns({c: F.round(cells.column(c), digits) for c in cols})


def winsorize(
    df: DataFrame, columns=None, order_by=(), factor: float = rules.FLAG_OUTLIER_IQR
) -> DataFrame:
    """Pull values outside the IQR bounds to the bounds; no row is removed."""
    bounds = iqr_bounds(df, columns or numeric_columns(df, order_by), factor)

    def pull(c):
        v = cells.clean_number(c)
        low, high = bounds[c]
        return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))

    return df.withColumns({c: pull(c) for c in bounds})


def check_calculation(
    df: DataFrame, column: str, expression: str, tolerance: float = 0.01
) -> DataFrame:
    """Add ``{column}__expected`` and ``{column}__wrong`` from a SQL expression."""
    expected = F.expr(expression).cast("double")
    wrong = cells.clean_number(F.abs(cells.column(column) - expected)) > tolerance
    return df.withColumns(
        {f"{column}__expected": expected, f"{column}__wrong": F.coalesce(wrong, F.lit(False))}
    )


def fix_calculation(
    df: DataFrame, column: str, expression: str, tolerance: float = 0.01
) -> DataFrame:
    """Replace values that differ from the recomputed ones by more than the tolerance."""
    expected = F.expr(expression).cast("double")
    difference = cells.clean_number(F.abs(cells.column(column) - expected))
    wrong = F.coalesce(difference > tolerance, F.lit(False))
    return df.withColumn(column, F.when(wrong, expected).otherwise(cells.column(column)))


def calculation_report(
    df: DataFrame, column: str, expression: str, tolerance: float = 0.01
) -> DataFrame:
    """checked, wrong, max_difference in one pass."""
    diff = cells.clean_number(F.abs(cells.column(column) - F.expr(expression).cast("double")))
    return df.agg(
        F.count(diff).alias("checked"),
        F.count_if(diff > tolerance).alias("wrong"),
        F.max(diff).alias("max_difference"),
    )


def normalize_units(df: DataFrame, column: str, factors: DataFrame) -> DataFrame:
    """``12 kg`` to value in the base unit: adds ``{column}__value`` and ``{column}__unit``.

    ``factors`` has unit (lower case), base_unit, factor, one row per unit.
    """
    text = F.lower(cells.trim_text(column))
    shape = r"^([+-]?\d+(?:\.\d+)?)\s*([a-zµ%]+)$"
    parsed = df.withColumns(
        {
            "_number": F.nullif(F.regexp_extract(text, shape, 1), F.lit("")).try_cast("double"),
            "_unit": F.nullif(F.regexp_extract(text, shape, 2), F.lit("")),
        }
    )
    table = factors.select(F.col("unit").alias("_unit"), "base_unit", "factor")
    joined = parsed.join(table, "_unit", "left")
    return joined.select(
        *[cells.column(c) for c in df.columns],
        (F.col("_number") * F.col("factor")).alias(f"{column}__value"),
        F.col("base_unit").alias(f"{column}__unit"),
    )
