"""Date operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridwash.functions import cells
from gridwash.operators.sampling import as_list


def null_invalid_dates(df: DataFrame, columns) -> DataFrame:
    """Text that is no date becomes null; rows stay."""
    return df.withColumns(
        {
            c: F.when(cells.parse_datetime(c).isNotNull(), cells.column(c))
            for c in as_list(columns)
        }
    )


#: Days that ``fill_missing_dates`` adds to one key, at most.
MOST_DAYS = 100_000


def _day(df: DataFrame, date: str) -> Column:
    """The day of a date or time, or of any text that reads as one; else null."""
    if isinstance(df.schema[date].dataType, T.StringType):
        return F.to_date(cells.parse_datetime(date))
    return F.to_date(cells.column(date))


def missing_date_ranges(df: DataFrame, keys, date: str) -> DataFrame:
    """keys, missing_from, missing_to, days: the days between a key's first and last day
    on which it has no row, one row per gap however wide.

    A null key is a key; rows without a day, or with text that is no date, take no part.
    A key's days are collapsed before the window, so it orders days, not rows.
    """
    keys = as_list(keys)
    days = df.select(*[cells.column(k) for k in keys], _day(df, date).alias("_day")).where("_day IS NOT NULL").distinct()
    following = F.lead("_day").over(Window.partitionBy(*[cells.column(k) for k in keys]).orderBy("_day"))
    gaps = days.withColumn("_next", following).where(F.date_diff("_next", "_day") > 1)
    return gaps.select(
        *[cells.column(k) for k in keys],
        F.date_add("_day", 1).alias("missing_from"),
        F.date_sub("_next", 1).alias("missing_to"),
        (F.date_diff("_next", "_day") - 1).alias("days"),
    )


def fill_missing_dates(df: DataFrame, keys, date: str, most_days: int = MOST_DAYS) -> DataFrame:
    """One more row for every day between a key's first and last day that has none.

    The added days have null values; all given rows are kept, with the date as a day. A
    text column stays text: added days are written as yyyy-MM-dd and so are dates that
    can be read, text that cannot is kept as it is. A null key is a key of its own. More
    than ``most_days`` days missing for one key raise an error: see
    :func:`missing_date_ranges` for gaps of any width.
    """
    keys = as_list(keys)
    kind = df.schema[date].dataType
    text = isinstance(kind, T.StringType)
    day = _day(df, date)
    own = F.coalesce(F.date_format(day, "yyyy-MM-dd"), cells.column(date)) if text else day
    rows = df.select(*[own.alias(c) if c == date else cells.column(c) for c in df.columns])
    gaps = missing_date_ranges(df, keys, date)
    total = F.sum("days").over(Window.partitionBy(*[cells.column(k) for k in keys]))
    message = F.format_string("%d missing days for one key; at most %d are filled in", total, F.lit(most_days))
    bounded = F.when(total > most_days, F.raise_error(message).cast("date")).otherwise(F.col("missing_to"))
    added = gaps.withColumn("_to", bounded).select(
        *[cells.column(k) for k in keys], F.explode(F.sequence("missing_from", "_to")).alias("_day")
    )
    filled = F.date_format("_day", "yyyy-MM-dd") if text else F.col("_day")
    types = {f.name: f.dataType for f in df.schema}
    added = added.select(
        *[
            filled.alias(c) if c == date else cells.column(c) if c in keys else F.lit(None).cast(types[c]).alias(c)
            for c in df.columns
        ]
    )
    names = [*keys, date, *[c for c in df.columns if c not in (*keys, date)]]
    return rows.unionByName(added).select(*[cells.column(c) for c in names])


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """Add year, month, day, quarter and day of week (1 = Sunday)."""
    c = cells.column(column)
    return df.withColumns(
        {
            f"{column}__year": F.year(c),
            f"{column}__month": F.month(c),
            f"{column}__day": F.dayofmonth(c),
            f"{column}__quarter": F.quarter(c),
            f"{column}__weekday": F.dayofweek(c),
        }
    )


def convert_zone(c, source: str, target: str) -> Column:
    """Wall-clock time of one zone as wall-clock time of another."""
    return F.convert_timezone(F.lit(source), F.lit(target), cells.column(c).cast("timestamp_ntz"))


def split_datetime(df: DataFrame, column: str) -> DataFrame:
    """Add ``{column}__date`` and ``{column}__time`` (HH:mm:ss)."""
    c = cells.column(column)
    return df.withColumns(
        {f"{column}__date": F.to_date(c), f"{column}__time": F.date_format(c, "HH:mm:ss")}
    )


def fix_date_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    """Swap start and end where they are reversed; a missing side stays missing."""
    s, e = cells.column(start), cells.column(end)
    swap = F.coalesce(s > e, F.lit(False))
    return df.withColumns(
        {start: F.when(swap, e).otherwise(s), end: F.when(swap, s).otherwise(e)}
    )
