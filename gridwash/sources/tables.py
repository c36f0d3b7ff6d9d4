"""Readers and writers for plain tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridwash.functions import cells
from gridwash.sources import records


def read_raw_table(
    spark: SparkSession, path: str, n_columns: int | None = None, multi_line: bool = True, **options
) -> DataFrame:
    """A headerless CSV as text columns c0..cn plus ``row_id``, in file order.

    Every cell is kept: without ``n_columns`` the widest row decides, not the first one,
    so a narrow title line cuts nothing off. ``multi_line`` lets quoted cells hold line
    breaks; a file is then one task, so switch it off for large files without any.
    ``row_id`` is monotone within each file. For a folder of files use
    :func:`read_raw_folder`, which also names the file.
    """
    reader = spark.read.options(header=False, inferSchema=False, multiLine=multi_line, escape='"')
    reader = reader.options(**options)
    if n_columns is None:
        sep = options.get("sep", options.get("delimiter", ","))
        n_columns = _widest(spark, reader, path, sep)
    raw = reader.schema(", ".join(f"c{i} string" for i in range(n_columns))).csv(path)
    return raw.select(F.monotonically_increasing_id().alias("row_id"), "*")


def _widest(spark, reader, path: str, sep: str) -> int:
    """Columns up to the last one that holds a cell, and at least those of the first row.

    The separators of a line tell how many columns to try; as long as the upper half of
    them holds a cell (rows may span lines), twice as many are tried.
    """
    first = len(reader.csv(path).columns)
    parts = F.size(F.split("value", re.escape(sep)))
    tried = 2 * max(first, spark.read.text(path).agg(F.max(parts)).first()[0] or 1)
    while True:
        names = [f"c{i}" for i in range(tried)]
        raw = reader.schema(", ".join(f"{c} string" for c in names)).csv(path)
        last = F.greatest(F.lit(0), *[F.when(F.col(c).isNotNull(), i + 1) for i, c in enumerate(names)])
        used = raw.agg(F.max(last)).first()[0] or 0
        if used <= tried // 2:
            return max(first, used)
        tried *= 2


def read_raw_folder(spark: SparkSession, path: str, n_columns: int = 1, **options) -> DataFrame:
    """Headerless CSV files, one or many: ``file``, ``row_id`` (order within the file),
    c0..cn as text.

    Every cell is kept: there are as many columns as the widest row of all files has cells,
    and at least ``n_columns``. Quoted cells may hold line breaks; a large file is still
    read by many tasks (see ``records``). Blank lines are no rows. Options are those of
    Spark's CSV reader that concern single cells, and ``sep``.
    """
    sep = options.pop("sep", options.pop("delimiter", ","))
    found = records.read_records(spark, path, sep).where(F.trim("text") != "")
    widest = found.agg(F.max("cells")).first()[0] or 0
    return found.select("file", "row_id", *records.parse_records(max(n_columns, widest), sep, **options))


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None) -> DataFrame:
    """A table with its own header or schema: csv, json, parquet or orc.

    Give a ``schema`` for large CSV and JSON, which saves the inference scan.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    return reader.format(fmt).load(path)


def resolve_table(catalog: DataFrame, wanted: str, name: str = "name", place: str = "position") -> DataFrame:
    """One row: the exact name, else a case-insensitive match, else the first table."""
    n = cells.column(name)
    rank = F.when(n == wanted.strip(), 0).when(F.lower(n) == wanted.strip().lower(), 1).otherwise(2)
    return catalog.agg(
        F.min_by(n, F.struct(rank.alias("r"), cells.column(place))).alias(name),
        F.min(rank).alias("rank"),
    )


def cells_to_table(grid: DataFrame, n_columns: int, row: str = "row", keys=()) -> DataFrame:
    """(row, col, value) cells to a wide table with columns c0..cn.

    Column numbers are known, so each is one conditional aggregate: no pivot scan.
    """
    return grid.groupBy(*keys, row).agg(
        *[F.max(F.when(F.col("col") == i, F.col("value"))).alias(f"c{i}") for i in range(n_columns)]
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partitions=("dataset", "sheet")) -> None:
    """Write one or more sheets into a multi-sheet table; other sheets stay."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def record_json(df: DataFrame, columns) -> Column:
    """One row as a JSON object with explicit nulls."""
    return cells.row_json({f.name: f.dataType for f in df.schema}, columns)


def to_records_json(df: DataFrame, order_by=()) -> DataFrame:
    """One JSON record per row, with the order columns."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.select(
        *[cells.column(k) for k in keys],
        record_json(df, [c for c in df.columns if c not in keys]).alias("record"),
    )


def sheet_summary(df: DataFrame, sheet: str, order_by=()) -> DataFrame:
    """sheet, columns (JSON list), rows, n_columns: the header of a records export."""
    keys = {sheet, *([order_by] if isinstance(order_by, str) else order_by)}
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(cells.column(sheet)).agg(
        F.count("*").alias("rows"),
        F.first(F.lit(len(cols))).alias("n_columns"),
        F.first(F.to_json(F.array(*[F.lit(c) for c in cols]))).alias("columns"),
    )
