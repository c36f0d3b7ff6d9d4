"""The first k non-null values of every column, by an explicit order column.

The head of the table, a bounded number of rows that each task keeps while it is
scanned, is one partition; what is asked of its values is worked out there, in the same
job, and one row per column comes to the driver. Only columns that are too sparse for the
head see the rest of the table: unpivoting keeps that scan single, and
``row_number() <= k`` lets Spark prune each task to k rows per column before the shuffle
(window group limit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from gridwash.functions import cells

#: Rows of the head, at least.
_HEAD = 1_000
_DISTINCT_HEAD = 1_000
#: Name of the column that every row of a head has a value in.
_ANY = "_any row"


def as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def data_columns(df: DataFrame, order_by) -> list[str]:
    """Columns that are data, not order columns."""
    keys = set(as_list(order_by)) if order_by else set()
    return [c for c in df.columns if c not in keys]


def text_columns(df: DataFrame, order_by=()) -> list[str]:
    keys = set(as_list(order_by)) if order_by else set()
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in keys
    ]


def numeric_columns(df: DataFrame, order_by=()) -> list[str]:
    keys = set(as_list(order_by)) if order_by else set()
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keys
    ]


def unpivot_text(df: DataFrame, columns, keep=()) -> DataFrame:
    """(keep..., column, value): one row per non-missing cell, values as text."""
    types = {f.name: f.dataType for f in df.schema}
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(~cells.is_missing(c, types[c]), cells.safe_str(c, types[c])).alias("value"),
        )
        for c in columns
    ]
    long = df.select(*[cells.column(k) for k in keep], F.inline(F.array(*pairs)))
    return long.where(F.col("value").isNotNull())


def _top(df: DataFrame, columns, order_by, k) -> DataFrame:
    ordered = df.select(
        *[cells.column(o).alias(f"_o{i}") for i, o in enumerate(order_by)],
        *[cells.column(c) for c in columns if c not in order_by],
    )
    keys = [f"_o{i}" for i in range(len(order_by))]
    first = Window.partitionBy("column").orderBy(*keys, "value")
    return (
        unpivot_text(ordered, columns, keep=keys)
        .withColumn("pos", F.row_number().over(first))
        .where(F.col("pos") <= k)
        .select("column", "pos", "value")
    )


def _head(df: DataFrame, columns, order_by, size: int) -> DataFrame:
    """The first rows of the table, one partition, with ``_full``: there may be more rows.

    Rows that tie with the last one may lie outside; a full head ends before them. If all
    of them tie it is empty.
    """
    used = dict.fromkeys([*order_by, *columns])
    place = F.struct(*[cells.column(o) for o in order_by])
    whole = Window.partitionBy(F.lit(0))
    first = df.select(*[cells.column(c) for c in used]).orderBy(*[cells.column(o) for o in order_by]).limit(size)
    marked = first.select("*", (F.count("*").over(whole) >= size).alias("_full"), F.max(place).over(whole).alias("_last"))
    return marked.where(~F.col("_full") | (place < F.col("_last"))).drop("_last")


def _sampled_head(df: DataFrame, columns, order_by, k: int, size: int):
    """(column, pos, value, full) of the head, and of a column without a name, so that a
    table has a row even if its columns are empty there."""
    head = _head(df, columns, order_by, size)
    keys = [f"_o{i}" for i in range(len(order_by))]
    ordered = head.select(
        *[cells.column(o).alias(n) for o, n in zip(order_by, keys)], F.col("_full").alias("full"),
        F.lit("").alias(_ANY), *[cells.column(c) for c in columns if c not in order_by],
    )
    named = unpivot_text(ordered, [_ANY, *columns], keep=[*keys, "full"])
    place = F.row_number().over(Window.partitionBy("column").orderBy(*keys, "value"))
    return named.withColumn("pos", place).where(F.col("pos") <= k)


def sampled_rows(df: DataFrame, columns, order_by, k: int, aggregates, values: dict[str, int] | None = None):
    """(rows, schema) of :func:`sampled`, on the driver: one row per column with values."""
    columns, order_by, aggregates = list(columns), as_list(order_by), list(aggregates)
    own = _sampled_head(df, columns, order_by, k, max(_HEAD, 2 * k)).groupBy("column").agg(
        *aggregates, F.count("*").alias("_n"), F.first("full").alias("_full")
    )
    schema = T.StructType([f for f in own.schema if f.name not in ("_n", "_full")])
    if not columns:
        return [], schema
    rows = {r["column"]: r for r in own.collect()}
    # Without any row the head holds nothing but ties, or the table nothing at all.
    full = rows[_ANY]["_full"] if _ANY in rows else True
    found = {c: rows[c]["_n"] if c in rows else 0 for c in columns}
    sparse = [c for c in columns if full and found[c] < min(k, (values or {}).get(c, k))]
    out = [rows[c] for c in columns if c in rows and c not in sparse]
    if sparse:
        out += _top(df, sparse, order_by, k).groupBy("column").agg(*aggregates).collect()
    return out, schema


def sampled(df: DataFrame, columns, order_by, k: int, aggregates, values: dict[str, int] | None = None) -> DataFrame:
    """column and one field per aggregate over ``pos`` and ``value`` of the first ``k``
    non-null values of each column; columns without values have no row.

    The head settles every column that has k values there, or as many as ``values`` says
    the column has at all. One row per column goes through the driver.
    """
    rows, schema = sampled_rows(df, columns, order_by, k, aggregates, values)
    return df.sparkSession.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


def first_k(df: DataFrame, columns, order_by, k: int) -> DataFrame:
    """(column, pos, value) for the first ``k`` non-null values of each column."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("found")
    return sampled(df, columns, order_by, k, [ordered]).select("column", F.inline("found"))


def _distinct_of(seen: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("column").orderBy("first_seen", "value")
    return (
        seen.withColumn("pos", F.row_number().over(first))
        .where(F.col("pos") <= k)
        .select("column", "pos", "value")
    )


def first_distinct(df: DataFrame, columns, order_by, k: int) -> DataFrame:
    """(column, pos, value) for the first ``k`` distinct values of each column.

    The head of the table settles a column when it holds k distinct values or is all
    there is. Only columns of few distinct values are left, and those collapse map-side
    in the full pass.
    """
    columns, order_by = list(columns), as_list(order_by)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, pos int, value string")
    seen = (
        _sampled_head(df, columns, order_by, _DISTINCT_HEAD, max(_HEAD, _DISTINCT_HEAD))
        .groupBy("column", "value")
        .agg(F.min("pos").alias("first_seen"), F.first("full").alias("full"))
    )
    # A column's list holds at most the sampled values; k of them leave the task.
    firsts = seen.groupBy("column").agg(
        F.count("*").alias("d"),
        F.first("full").alias("full"),
        F.slice(F.array_sort(F.collect_list(F.struct("first_seen", "value"))), 1, k).alias("first"),
    )
    rows = {r["column"]: r for r in firsts.collect()}
    full = rows[_ANY]["full"] if _ANY in rows else True
    repeating = [c for c in columns if full and (c not in rows or rows[c]["d"] < k)]
    settled = df.sparkSession.createDataFrame(
        [
            (c, pos, pair["value"])
            for c, r in rows.items()
            if c in columns and c not in repeating
            for pos, pair in enumerate(r["first"], start=1)
        ],
        "column string, pos int, value string",
    )
    if not repeating:
        return settled
    keys = [f"_o{i}" for i in range(len(order_by))]
    ordered = df.select(
        *[cells.column(o).alias(f"_o{i}") for i, o in enumerate(order_by)],
        *[cells.column(c) for c in repeating if c not in order_by],
    )
    # One order column stays a plain value: a hash aggregate instead of a sort.
    place = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    full = (
        unpivot_text(ordered, repeating, keep=keys)
        .groupBy("column", "value")
        .agg(F.min(place).alias("first_seen"))
    )
    return settled.unionByName(_distinct_of(full, k))
