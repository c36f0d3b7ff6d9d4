"""Ordered scans within keys that survive a hot key.

A window per key puts a whole key into one task. So the order range is cut into chunks,
the window runs per (key, chunk), and one small row per (key, chunk) carries state to
the later chunks. A table whose largest key fits a task is one chunk of the same plan.
The bounds of the chunks pass through the driver, so there are few of them; a limit that
asks for more chunks cuts each of these, by the rank within the key, in the tasks.
Rows that tie in all order columns are ordered by a hash of the row, so ties give the
same answer in every run and are cut as well; only rows that are equal in every column
stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridwash.functions import cells
from gridwash.operators.sampling import as_list

GROUP_LIMIT = 5_000_000
#: Chunks by bounds, unless keys of more than ``GROUP_LIMIT`` rows a chunk need more.
RANGES = 256
CHUNK, PART, TIE = "_chunk", "_part", "_tie"


def largest_group(df: DataFrame, keys) -> int:
    """Rows of the largest key group: partial counts, one number to the driver."""
    counted = df.groupBy(*[cells.column(k) for k in as_list(keys)]).count()
    return counted.agg(F.max("count")).first()[0] or 0


def _chunk_number(place: Column, bounds) -> Column:
    """Balanced comparison tree: chunk = number of bounds <= place."""

    def tree(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(place < bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def with_chunks(df: DataFrame, order_by, chunks: int) -> DataFrame:
    """Add ``_chunk``: ranges of the order columns taken together, of about equal size.

    Bounds are places of a bounded sample: the order values with the smallest hashes,
    64 per chunk, whatever their types. Equal leading values are told apart by the order
    columns behind them; nulls sort first.
    """
    if chunks == 1:
        return df.withColumn(CHUNK, F.lit(0))
    names = [f"_o{i}" for i in range(len(as_list(order_by)))]
    places = df.select(*[cells.column(o).alias(n) for o, n in zip(as_list(order_by), names)])
    sample = places.orderBy(F.xxhash64(*names), *names).limit(64 * chunks)
    rank = F.row_number().over(Window.orderBy(*names)) - 1
    cut = sample.withColumn("_r", rank).where((F.col("_r") % 64 == 0) & (F.col("_r") > 0))
    bounds = [
        F.struct(*[F.lit(r[n]).cast(f.dataType).alias(n) for n, f in zip(names, places.schema)])
        for r in cut.orderBy("_r").collect()
    ]
    place = F.struct(*[cells.column(o).alias(n) for o, n in zip(as_list(order_by), names)])
    return df.withColumn(CHUNK, _chunk_number(place, bounds))


def chunked(df: DataFrame, keys, order_by, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The table with ``_tie`` (a hash of the row), ``_chunk`` and ``_part`` (a piece of a
    key's rows in a chunk), so that no key has more than about ``group_limit`` rows in a
    part."""
    hashed = [cells.column(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType)]
    tied = df.withColumn(TIE, F.xxhash64(*hashed))
    biggest = largest_group(df, keys)
    # Twice the needed number, as chunk sizes are approximate.
    chunks = 2 * -(-biggest // group_limit) if biggest > group_limit else 1
    most = max(RANGES, 2 * -(-biggest // GROUP_LIMIT))
    cut = with_chunks(tied, [*as_list(order_by), TIE], min(chunks, most))
    if chunks <= most:
        return cut.withColumn(PART, F.lit(0))
    within = Window.partitionBy(*[cells.column(k) for k in as_list(keys)], CHUNK)
    place = F.rank().over(within.orderBy(*[cells.column(o) for o in [*as_list(order_by), TIE]])) - 1
    return cut.withColumn(PART, F.floor(place / group_limit).cast("int"))


def _window(keys, order_by, backward=False):
    order = [cells.column(o).desc() if backward else cells.column(o).asc() for o in [*order_by, TIE]]
    return Window.partitionBy(*[cells.column(k) for k in keys], CHUNK, PART).orderBy(*order)


def _carry(cut: DataFrame, keys, local: DataFrame, states: dict, folds: dict, backward=False):
    """Join to ``local`` the state that earlier (later) parts of the same key hand over."""
    places = [F.col(c).desc() if backward else F.col(c).asc() for c in (CHUNK, PART)]
    over = Window.partitionBy(*[cells.column(k) for k in keys]).orderBy(*places)
    state = (
        cut.groupBy(*[cells.column(k) for k in keys], CHUNK, PART)
        .agg(*[agg.alias(n) for n, agg in states.items()])
        .select(
            *[cells.column(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col(CHUNK).alias("_c"),
            F.col(PART).alias("_p"),
            *[folds[n](cells.column(n), over).alias(n) for n in states],
        )
    )
    match = (F.col(CHUNK) == F.col("_c")) & (F.col(PART) == F.col("_p"))
    for i, k in enumerate(keys):
        match = match & cells.column(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(state, match, "left")


def fill_along(
    df: DataFrame, keys, order_by, columns, backward: bool = False, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Forward (or backward) fill of ``columns`` within each key, by the order columns."""
    keys, order_by, columns = as_list(keys), as_list(order_by), as_list(columns)
    cut = chunked(df, keys, order_by, group_limit)
    seen = _window(keys, order_by, backward).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({c: F.last(cells.column(c), True).over(seen) for c in columns})
    place = F.struct(*[cells.column(o) for o in [*order_by, TIE]])
    pick = F.min_by if backward else F.max_by
    states = {
        f"_s{i}": pick(cells.column(c), F.when(cells.column(c).isNotNull(), place))
        for i, c in enumerate(columns)
    }

    def last_known(v, over):
        return F.last(v, True).over(over.rowsBetween(Window.unboundedPreceding, -1))

    joined = _carry(cut, keys, local, states, dict.fromkeys(states, last_known), backward)
    filled = {
        c: F.coalesce(cells.column(c), F.col(f"_s{i}")) for i, c in enumerate(columns)
    }
    return joined.withColumns(filled).select(*[cells.column(c) for c in df.columns])


def running_total(
    df: DataFrame, keys, order_by, column: str, total: str, delta: str, group_limit=GROUP_LIMIT
) -> DataFrame:
    """Add the running sum of ``column`` and its change from the previous row (0 at first,
    and where either value is null)."""
    keys, order_by = as_list(keys), as_list(order_by)
    cut = chunked(df, keys, order_by, group_limit)
    w = _window(keys, order_by)
    v = cells.column(column)
    local = cut.withColumns(
        {
            total: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_previous": F.lag(v).over(w),
            "_first": F.row_number().over(w) == 1,
        }
    )
    states = {
        "_sum": F.sum(v),
        "_last": F.max_by(v, F.struct(*[cells.column(o) for o in [*order_by, TIE]])),
    }
    folds = {
        "_sum": lambda c, over: F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, -1)),
        "_last": lambda c, over: F.lag(c).over(over),
    }
    joined = _carry(cut, keys, local, states, folds)
    so_far = F.coalesce(cells.column(total) + F.col("_sum"), cells.column(total), F.col("_sum"))
    # Only the first row of a part has its previous row in an earlier one.
    previous = F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_previous"))
    return joined.select(
        *[cells.column(c) for c in df.columns], so_far.alias(total), F.coalesce(v - previous, F.lit(0)).alias(delta)
    )


def as_of(
    left: DataFrame, right: DataFrame, keys, left_order: str, right_order: str, columns, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` of the same key whose place
    is not after the left row's.

    Both tables are put into one order, right rows before left rows of the same place,
    and the last right row is carried along, chunk by chunk, so a hot key is many tasks
    and no pairs are formed. A left row before the first right row of its key, of a key
    without any or without a place gets nulls; right rows without a place take no part; a
    null key is a key. Of right rows of one key and place the largest, column by column,
    counts (nulls are smallest).
    """
    keys, columns = as_list(keys), as_list(columns)
    names = [f"_key{i}" for i in range(len(keys))]
    kind = F.struct(cells.column(left_order)).alias("x")
    place = left.select(kind).schema["x"].dataType[0].dataType
    value = F.struct(*[cells.column(c).alias(f"c{i}") for i, c in enumerate(columns)])
    known = right.where(cells.column(right_order).isNotNull()).groupBy(
        *[cells.column(k).alias(n) for k, n in zip(keys, names)], cells.column(right_order).cast(place).alias("_at")
    ).agg(F.max(value).alias("_value"))
    rows = left.select(
        *[cells.column(k).alias(n) for k, n in zip(keys, names)], cells.column(left_order).alias("_at"),
        F.struct(*[cells.column(c) for c in left.columns]).alias("_row"),
    )
    both = known.withColumn("_asks", F.lit(False)).unionByName(rows.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    filled = fill_along(both, names, ["_at", "_asks"], "_value", group_limit=group_limit).where("_asks")
    given = [F.col("_row")[c].alias(c) for c in left.columns]
    return filled.select(*given, *[F.col("_value")[f"c{i}"].alias(c) for i, c in enumerate(columns)])
