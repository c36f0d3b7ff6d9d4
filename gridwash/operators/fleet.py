"""Reports over many tables at once, with totals on every level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwash.functions import cells, formats
from gridwash.operators.profile import _types
from gridwash.operators.sampling import as_list

#: Level of a row by how many of dataset, sheet, column and format it sums over.
LEVELS = {0: "format", 1: "column", 3: "sheet", 7: "dataset", 15: "all"}


def fleet_report(
    df: DataFrame, dataset: str = "dataset", sheet: str = "sheet", order_by=(), found: dict | None = None
) -> DataFrame:
    """dataset, sheet, column, format, level, cells, missing, missing_percent, checked,
    violations: gaps and format violations of a fleet of tables, one row per table and
    column, and sums of them per sheet, per dataset and over all.

    ``level`` tells what a row sums up ('format', 'column', 'sheet', 'dataset', 'all');
    a null dataset or sheet of the data is told apart from a sum by it. ``found`` maps a
    column to its format (without it the names decide); other columns have no format, and
    nothing of them is checked. Blank text is not checked either.

    One pass reads the table: a wide aggregate per dataset and sheet, which combines
    map-side, so a table of a third of all rows is a row per task. The levels are rolled
    up from that small result.
    """
    types = _types(df)
    cols = [c for c in df.columns if c not in (dataset, sheet, *as_list(order_by))]
    known = {c: f for c in cols if (f := formats.detect_format_by_name(c))} if found is None else found
    miss = {c: cells.is_missing(c, types[c]) for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.count_if(miss[c]).alias(f"_m{i}"))
        if c in known:
            text = cells.safe_str(c, types[c])
            aggs.append(F.count_if(~cells.is_blank(text)).alias(f"_c{i}"))
            aggs.append(F.count_if(~cells.is_blank(text) & ~formats.is_valid(text, known[c])).alias(f"_v{i}"))
    wide = df.groupBy(cells.column(dataset).alias("dataset"), cells.column(sheet).alias("sheet")).agg(
        F.count("*").alias("cells"), *aggs
    )
    zero = F.lit(0).cast("long")
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(known.get(c)).cast("string").alias("format"), F.col(f"_m{i}").alias("missing"),
            (F.col(f"_c{i}") if c in known else zero).alias("checked"), (F.col(f"_v{i}") if c in known else zero).alias("violations"),
        )
        for i, c in enumerate(cols)
    ]
    long = wide.select("dataset", "sheet", "cells", F.inline(F.array(*rows)))
    names = [F.lit(x) for pair in LEVELS.items() for x in pair]
    level = F.create_map(*names)[F.grouping_id().cast("int")]
    counts = ("cells", "missing", "checked", "violations")
    rolled = long.rollup("dataset", "sheet", "column", "format").agg(level.alias("level"), *[F.sum(c).alias(c) for c in counts])
    return rolled.select(
        "dataset", "sheet", "column", "format", "level", "cells", "missing",
        F.try_divide(F.col("missing") * 100.0, F.col("cells")).alias("missing_percent"), "checked", "violations",
    )
