"""Structural operations: empties, merged cells, multi-row headers, duplicate sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridwash.functions import cells
from gridwash.operators import structure
from gridwash.operators.sampling import as_list, data_columns


def remove_empty(df: DataFrame, order_by=()) -> DataFrame:
    """Drop completely empty rows, then completely empty columns."""
    return structure.drop_empty_columns(structure.drop_empty_rows(df, order_by), order_by)


def fill_merged_cells(grid: DataFrame, ranges: DataFrame) -> DataFrame:
    """Give every cell of a merged range the value of its top-left cell.

    ``grid`` has sheet, row, col, value; ``ranges`` has sheet, min_row, max_row,
    min_col, max_col. Ranges unfold to the cells they cover, so both joins are
    equi-joins on (sheet, row, col), which no sheet can skew.
    """
    covered = ranges.select(
        "sheet",
        F.col("min_row").alias("top"),
        F.col("min_col").alias("left"),
        F.explode(F.sequence("min_row", "max_row")).alias("row"),
        "min_col",
        "max_col",
    ).select(
        "sheet", "top", "left", "row", F.explode(F.sequence("min_col", "max_col")).alias("col")
    )
    corner = grid.select(
        "sheet", F.col("row").alias("top"), F.col("col").alias("left"), F.col("value").alias("corner")
    )
    merged = covered.join(corner, ["sheet", "top", "left"], "left").select(
        "sheet", "row", "col", "corner", F.lit(True).alias("merged")
    )
    return grid.join(merged, ["sheet", "row", "col"], "full").select(
        "sheet",
        "row",
        "col",
        F.when(F.coalesce("merged", F.lit(False)), F.col("corner"))
        .otherwise(F.col("value"))
        .alias("value"),
    )


def merge_header_rows(df: DataFrame, order_by, k: int, sep: str = "_") -> DataFrame:
    """The first k rows become one header: their non-blank cells joined per column."""
    rows = structure.leading_rows(df, order_by, k)
    if len(rows) < k:
        return df
    cols = data_columns(df, order_by)

    def joined(c):
        parts = [str(r[c]).strip() for r in rows if r[c] is not None]
        return sep.join(p for p in parts if p)

    names = structure.header_names([joined(c) for c in cols])
    return structure._rename_data(structure._after(df, order_by, rows[-1]), order_by, names)


def sheet_fingerprints(df: DataFrame, sheet: str, order_by=()) -> DataFrame:
    """sheet, rows and an order-free 128-bit fingerprint of each sheet's rows.

    Row hashes are summed, so partial sums combine map-side and one huge sheet is
    no hot group.
    """
    cols = [c for c in data_columns(df, order_by) if c != sheet]
    row = cells.row_json({f.name: f.dataType for f in df.schema}, cols)

    def total(h: Column) -> Column:
        return F.sum(h.cast("decimal(20,0)"))

    return df.groupBy(cells.column(sheet)).agg(
        F.count("*").alias("rows"),
        total(F.xxhash64(F.lit(1), row)).alias("print_1"),
        total(F.xxhash64(F.lit(2), row)).alias("print_2"),
    )


def duplicate_sheets(df: DataFrame, sheet: str, order_by=()) -> DataFrame:
    """sheet, duplicate_of: sheets whose rows equal those of an earlier-named sheet."""
    prints = sheet_fingerprints(df, sheet, order_by)
    same = ["rows", "print_1", "print_2"]
    first = prints.groupBy(*same).agg(F.min(cells.column(sheet)).alias("duplicate_of"))
    return (
        prints.join(first, same)
        .where(cells.column(sheet) != F.col("duplicate_of"))
        .select(sheet, "duplicate_of")
    )


def remove_duplicate_sheets(df: DataFrame, sheet: str, order_by=()) -> DataFrame:
    """Keep one copy of every sheet (explicit request only)."""
    return df.join(duplicate_sheets(df, sheet, order_by).select(sheet), sheet, "left_anti")


def split_column(df: DataFrame, column: str, sep: str, names) -> DataFrame:
    """Split a combined column into named parts; missing parts are null."""
    parts = F.split(cells.column(column), sep)
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def explode_column(df: DataFrame, column: str, sep: str) -> DataFrame:
    """One row per part of a combined cell, with its position."""
    others = [cells.column(c) for c in df.columns if c != column]
    return df.select(
        *others, F.posexplode_outer(F.split(cells.column(column), sep)).alias("part_no", column)
    )


def sort_columns(df: DataFrame, order_by=()) -> DataFrame:
    """Data columns by name, order columns first."""
    keys = as_list(order_by) if order_by else []
    return df.select(*[cells.column(c) for c in [*keys, *sorted(data_columns(df, order_by))]])
