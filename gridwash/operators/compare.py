"""What differs between two versions of a table: rows as a multiset, cells by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwash.functions import cells
from gridwash.operators.profile import _types, per_column, side_by_side
from gridwash.operators.sampling import as_list, data_columns


def row_difference(before: DataFrame, after: DataFrame, order_by=()) -> DataFrame:
    """change ('lost' or 'added'), copies and the row: how often each row is in one table
    more often than in the other, without the order columns.

    Lost rows are ``before EXCEPT ALL after``, added ones the reverse, with equal rows
    once and their number. Rows are equal if all values are: null equals null and NaN,
    -0.0 equals 0.0. Both tables need the same columns; types may differ, then values are
    compared as the type both fit. Rows collapse by a 256-bit digest before the
    shuffle, so copies cost one row per task and equal tables move only digests and one
    instance of each row per task.
    """
    cols = data_columns(before, order_by)
    row = F.struct(*[F.col(f"_v{i}").alias(f"_v{i}") for i in range(len(cols))])
    counted = _balance(before, after, order_by, F.first(row).alias("_row"))
    return counted.select(
        F.when(F.col("_n") > 0, "lost").otherwise("added").alias("change"),
        F.abs("_n").alias("copies"),
        *[F.col("_row")[f"_v{i}"].alias(c) for i, c in enumerate(cols)],
    )


def _balance(before: DataFrame, after: DataFrame, order_by, *aggregates) -> DataFrame:
    """(_digest, _n, aggregates over the values _v0..): rows that are not in balance."""
    cols = data_columns(before, order_by)
    if set(cols) != set(data_columns(after, order_by)):
        raise ValueError("both tables need the same columns")

    def side(df, sign):
        return df.select(*[cells.column(c).alias(f"_v{i}") for i, c in enumerate(cols)], F.lit(sign).alias("_side"))

    both = side(before, 1).unionByName(side(after, -1))
    types, names = _types(both), [f"_v{i}" for i in range(len(cols))]
    digest = F.unhex(F.sha2(cells.row_json(types, names), 256))
    known = both.select("_side", digest.alias("_digest"), *[cells.known(n, types[n]).alias(n) for n in names])
    return known.groupBy("_digest").agg(F.sum("_side").alias("_n"), *aggregates).where("_n <> 0")


def difference_counts(before: DataFrame, after: DataFrame, order_by=()) -> DataFrame:
    """lost, added, kept: how many rows (with copies) of two versions of a table."""
    n = F.col("_n")
    sums = {"lost": F.when(n > 0, n), "added": F.when(n < 0, -n)}
    totals = _balance(before, after, order_by).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()])
    rows = before.agg(F.count("*").alias("_rows"))
    return side_by_side([totals, rows]).select("lost", "added", (F.col("_rows") - F.col("lost")).alias("kept"))


def changed_cells(before: DataFrame, after: DataFrame, keys, columns=None) -> DataFrame:
    """column, common, changed, filled, emptied: cells that differ between rows of equal keys.

    ``filled`` cells were missing before, ``emptied`` ones are missing after; ``changed``
    counts both and those with another value. ``common`` is the number of keys in both
    tables; keys of one table only and null keys are no changes (see ``row_difference``).
    Keys are expected once per table; a repeated key stands for its smallest row, column
    by column. NaN is missing. Cells are compared in the order of types: as they are if
    both types are the same, else as text.
    """
    keys = as_list(keys)
    cols = [c for c in (columns or before.columns) if c not in keys and c in after.columns]
    old, new = _types(before), _types(after)

    def side(df, types, name):
        values = F.struct(
            *[
                (cells.known(c, types[c]) if old[c] == new[c] else cells.safe_str(cells.known(c, types[c]), types[c])).alias(f"c{i}")
                for i, c in enumerate(cols)
            ]
        )
        known = df.where(cells.all_of(cells.column(k).isNotNull() for k in keys))
        return known.groupBy(*[cells.column(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(values).alias(name))

    both = side(before, old, "_b").join(side(after, new, "_a"), [f"_k{i}" for i in range(len(keys))])
    place = {c: i for i, c in enumerate(cols)}

    def pair(c):
        return F.col("_b")[f"c{place[c]}"], F.col("_a")[f"c{place[c]}"]

    return per_column(
        both,
        cols,
        {
            "common": lambda c: F.count("*"),
            "changed": lambda c: F.count_if(~pair(c)[0].eqNullSafe(pair(c)[1])),
            "filled": lambda c: F.count_if(pair(c)[0].isNull() & pair(c)[1].isNotNull()),
            "emptied": lambda c: F.count_if(pair(c)[0].isNotNull() & pair(c)[1].isNull()),
        },
    )
