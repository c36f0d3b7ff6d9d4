"""Mergeable sketches of stored tables, kept beside them.

Every stored table has one row per column: counts, a sketch of its distinct values and,
for numbers, a sketch of its quantiles. A folder's or fleet's statistics are merged from
those rows; appended data is sketched by itself, and old data is never read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridwash.functions import cells
from gridwash.operators.sampling import data_columns

#: Size of the sketches: 2**LOG_K registers give about 1.04 / sqrt(2**LOG_K) (0.8 %)
#: standard error of distinct counts, K about 1.33 / K**0.95 (0.1 %) rank error.
LOG_K, K = 14, 2000
SCHEMA = (
    "dataset string, sheet string, id string, part string, column string, kind string, rows long, non_null long, "
    "values binary, numbers binary"
)


def column_sketches(df: DataFrame, order_by=()) -> DataFrame:
    """column, kind, rows, non_null, values, numbers: one row per column, in one pass.

    ``values`` sketches the distinct values as text, ``numbers`` the quantiles of numeric
    columns as doubles; NaN is missing. A column without values has empty sketches.
    """
    cols = data_columns(df, order_by)
    types = {f.name: f.dataType for f in df.schema}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(cols):
        known = cells.known(c, types[c])
        aggs += [F.count(known).alias(f"n{i}"), F.hll_sketch_agg(cells.safe_str(known, types[c]), F.lit(LOG_K)).alias(f"v{i}")]
        if isinstance(types[c], T.NumericType):
            aggs.append(F.kll_sketch_agg_double(cells.clean_number(c) + F.lit(0.0), F.lit(K)).alias(f"q{i}"))
    wide = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("kind"), F.col(f"n{i}").alias("non_null"), F.col(f"v{i}").alias("values"),
            (F.col(f"q{i}") if isinstance(types[c], T.NumericType) else F.lit(None).cast("binary")).alias("numbers"),
        )
        for i, c in enumerate(cols)
    ]
    long = wide.select("rows", F.inline(F.array(*rows)))
    return long.select("column", "kind", "rows", "non_null", "values", "numbers")


def write_sketches(df: DataFrame, root: str, dataset: str, sheet: str, id_: str, part: str, order_by=()) -> None:
    """Keep the sketches of a stored table, or of one appended ``part`` of it.

    Nothing but ``df`` is read. A part that is written again replaces itself when
    sketches are merged (the latest counts).
    """
    keys = {"dataset": dataset, "sheet": sheet, "id": id_, "part": part}
    own = column_sketches(df, order_by).select(*[F.lit(v).alias(k) for k, v in keys.items()], "*", F.current_timestamp().alias("ts"))
    own.coalesce(1).write.mode("append").parquet(f"{root}/sketches")


def read_sketches(spark: SparkSession, root: str) -> DataFrame:
    """The latest sketches of every part of every stored table."""
    log = spark.read.schema(SCHEMA + ", ts timestamp").parquet(f"{root}/sketches")
    # A part's columns are written together, so its latest instant has all of them.
    last = log.groupBy("dataset", "sheet", "id", "part").agg(F.max("ts").alias("ts"))
    return log.join(last, ["dataset", "sheet", "id", "part", "ts"]).drop("ts")


def merged(sketches: DataFrame, by=("dataset", "sheet"), probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """by, column, rows, non_null, distinct (estimated), quantiles (of numbers, estimated).

    Merges binary sketches of a fixed size, some kilobytes per column and table. With
    ``by=()`` over all tables. Columns that are numbers in some tables only have the
    quantiles of those.
    """
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("_q", F.lit(float(p))) for p in probs])
    out = sketches.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"),
        F.hll_sketch_estimate(F.hll_union_agg("values", F.lit(True))).alias("distinct"),
        F.kll_merge_agg_double("numbers").alias("_q"),
    )
    some = F.coalesce(F.kll_sketch_get_n_double("_q"), F.lit(0)) > 0
    return out.withColumn("quantiles", F.when(some, quantiles)).drop("_q")
