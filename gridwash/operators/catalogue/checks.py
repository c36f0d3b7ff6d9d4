"""Validation operations across rows and tables. Big sides are reduced by key before
they are joined, so a hot key costs one row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwash.functions import cells
from gridwash.operators.profile import iqr_bounds
from gridwash.operators.sampling import as_list


def validate_totals(
    parents: DataFrame, parent_key: str, total: str, children: DataFrame, child_key: str,
    amount: str, tolerance: float = 0.01,
) -> DataFrame:
    """key, total, child_total, difference for parents whose children do not add up."""
    sums = children.groupBy(cells.column(child_key).alias("_key")).agg(
        F.sum(cells.known(amount, children.schema[amount].dataType)).alias("child_total")
    )
    joined = parents.select(
        cells.column(parent_key).alias("_key"),
        cells.known(total, parents.schema[total].dataType).alias("total"),
    ).join(sums, "_key", "left")
    child = F.coalesce(F.col("child_total"), F.lit(0))
    diff = F.col("total") - child
    return joined.where(F.abs(diff) > tolerance).select(
        F.col("_key").alias("key"), "total", child.alias("child_total"), diff.alias("difference")
    )


def orphan_keys(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """key, rows: foreign keys without a parent, with the number of rows using them."""
    used = (
        df.where(cells.column(key).isNotNull())
        .groupBy(cells.column(key).alias("key"))
        .agg(F.count("*").alias("rows"))
    )
    known = parents.select(cells.column(parent_key).alias("key"))
    return used.join(known, "key", "left_anti")


def orphan_rows(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """The rows behind :func:`orphan_keys`."""
    bad = orphan_keys(df, key, parents, parent_key).select(F.col("key").alias("_key"))
    return df.join(bad, cells.column(key) == F.col("_key"), "left_semi")


def anomalies(
    df: DataFrame, column: str, keys=(), z_limit: float = 3.0
) -> DataFrame:
    """Add ``z_score`` and ``anomaly`` within each key (or overall).

    Key statistics are aggregated and joined back; no window sorts a hot key. NaN is
    missing: it takes no part and is never flagged.
    """
    v = cells.clean_number(column)
    keys = as_list(keys) if keys else []
    if not keys:
        row = df.agg(F.avg(v), F.stddev_samp(v)).first()
        score = F.lit(None).cast("double") if not row[1] else (v - row[0]) / row[1]
        return df.withColumn("z_score", score).withColumn(
            "anomaly", F.coalesce(F.abs("z_score") > z_limit, F.lit(False))
        )
    stats = df.groupBy(*[cells.column(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_std")
    )
    match = cells.all_of(
        cells.column(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)
    )
    joined = df.join(stats, match, "left")
    score = F.try_divide(v - F.col("_mean"), F.col("_std"))
    return joined.select(*[cells.column(c) for c in df.columns], score.alias("z_score")).withColumn(
        "anomaly", F.coalesce(F.abs("z_score") > z_limit, F.lit(False))
    )


def iqr_anomalies(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """The rows outside the IQR bounds of one column."""
    bounds = iqr_bounds(df, [column], factor)
    if column not in bounds:
        return df.limit(0)
    low, high = bounds[column]
    v = cells.clean_number(column)
    return df.where((v < F.lit(low)) | (v > F.lit(high)))


def check_rules(df: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """rule, checked, failed: every SQL predicate in one pass; null counts as failed."""
    names = list(predicates)
    row = df.agg(
        F.count("*").alias("_n"),
        *[
            F.count_if(~F.coalesce(F.expr(predicates[n]), F.lit(False))).alias(f"_f{i}")
            for i, n in enumerate(names)
        ],
    )
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("rule"),
                        F.col("_n").alias("checked"),
                        F.col(f"_f{i}").alias("failed"),
                    )
                    for i, n in enumerate(names)
                ]
            )
        )
    )


def cross_reference(
    df: DataFrame, key: str, reference: DataFrame, reference_key: str, columns
) -> DataFrame:
    """Add reference columns and ``found``; of several reference rows of a key the
    smallest one (by the columns in order) is taken whole."""
    columns = as_list(columns)
    record = F.struct(*[cells.column(c).alias(c) for c in columns])
    side = reference.groupBy(cells.column(reference_key).alias("_key")).agg(
        F.min(record).alias("_record")
    )
    joined = df.join(side, cells.column(key) == F.col("_key"), "left")
    return joined.select(
        *[cells.column(c) for c in df.columns],
        *[F.col("_record")[c].alias(c) for c in columns],
        F.col("_key").isNotNull().alias("found"),
    )


def hierarchy_breaks(
    df: DataFrame, child: str, parent: str, parents: DataFrame, parent_key: str
) -> DataFrame:
    """child, problem: children with an unknown parent or with several parents."""
    links = df.groupBy(cells.column(child).alias("child")).agg(
        F.min(cells.column(parent)).alias("_lo"), F.max(cells.column(parent)).alias("_hi")
    )
    several = links.where("_lo != _hi").select("child", F.lit("several parents").alias("problem"))
    known = parents.select(cells.column(parent_key).alias("_parent"))
    pairs = df.select(
        cells.column(child).alias("child"), cells.column(parent).alias("_parent")
    ).distinct()
    unknown = (
        pairs.where("_parent IS NOT NULL")
        .join(known, "_parent", "left_anti")
        .select("child", F.lit("unknown parent").alias("problem"))
        .distinct()
    )
    return several.unionByName(unknown)
