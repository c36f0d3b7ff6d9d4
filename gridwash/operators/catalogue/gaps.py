"""Missing-value operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwash.functions import cells
from gridwash.operators.ordered import GROUP_LIMIT, fill_along
from gridwash.operators.profile import missing_by_column
from gridwash.operators.quantiles import exact_quantiles
from gridwash.operators.sampling import as_list, data_columns, numeric_columns


def missing_patterns(df: DataFrame, order_by=()) -> DataFrame:
    """pattern, rows: one character per column, 1 = missing."""
    types = {f.name: f.dataType for f in df.schema}
    bits = [
        F.when(cells.is_missing(c, types[c]), "1").otherwise("0") for c in data_columns(df, order_by)
    ]
    return df.select(F.concat(*bits).alias("pattern")).groupBy("pattern").agg(
        F.count("*").alias("rows")
    )


def column_modes(df: DataFrame, columns) -> dict:
    """{column: most frequent value}; ties take the smallest value; None without values.

    All columns are counted in one job: cells are unpivoted, each into the field of its
    own column, and (column, value) counts combine map-side; the mode is an aggregate
    over them, so no task holds a column's distinct values.
    """
    columns = list(columns)
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema}
    known = [cells.known(c, types[c]) for c in columns]
    names = [f"v{i}" for i in range(len(columns))]
    cell = F.explode(F.array(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names)])).alias("_c")
    values = df.select(*[v.alias(n) for v, n in zip(known, names)]).select("*", cell).where("_c IS NOT NULL")
    own = [F.when(F.col("_c") == i, F.col(f"v{i}")).alias(f"v{i}") for i in range(len(columns))]
    counted = values.select("_c", *own).groupBy("_c", *names).count()
    # The smallest (-count, value) is the most frequent value, ties by value.
    top = counted.groupBy("_c").agg(F.min(F.struct((-F.col("count")).alias("n"), *names)).alias("top"))
    best = {r["_c"]: r["top"] for r in top.collect()}
    return {c: best[i][f"v{i}"] if i in best else None for i, c in enumerate(columns)}


def fill_with_statistic(
    df: DataFrame, statistic: str = "mean", columns=None, order_by=()
) -> DataFrame:
    """Fill nulls and NaN with the column's mean, median or mode: scalars, no join."""
    cols = list(columns or numeric_columns(df, order_by))
    types = {f.name: f.dataType for f in df.schema}
    if not cols:
        return df
    if statistic == "mean":
        row = df.agg(
            *[F.avg(cells.known(c, types[c])).alias(f"_{i}") for i, c in enumerate(cols)]
        ).first()
        values = {c: row[f"_{i}"] for i, c in enumerate(cols)}
    elif statistic == "median":
        values = {c: q[0] for c, q in exact_quantiles(df, cols, (0.5,)).items()}
    elif statistic == "mode":
        values = column_modes(df, cols)
    else:
        raise ValueError(f"unknown statistic: {statistic}")
    return df.withColumns(
        {
            c: F.coalesce(cells.known(c, types[c]), F.lit(v))
            for c, v in values.items()
            if v is not None
        }
    )


def forward_fill(df: DataFrame, keys, order_by, columns, group_limit=GROUP_LIMIT) -> DataFrame:
    return fill_along(df, keys, order_by, columns, False, group_limit)


def backward_fill(df: DataFrame, keys, order_by, columns, group_limit=GROUP_LIMIT) -> DataFrame:
    return fill_along(df, keys, order_by, columns, True, group_limit)


def drop_sparse_columns(df: DataFrame, order_by=(), threshold: float = 70.0) -> DataFrame:
    """Drop columns above a missing percentage (explicit request only)."""
    gaps = missing_by_column(df, order_by).where(F.col("missing_percent") > threshold)
    gone = {r["column"] for r in gaps.select("column").collect()}
    return df.select(*[cells.column(c) for c in df.columns if c not in gone])


def impute_regression(df: DataFrame, target: str, features) -> DataFrame:
    """Fill nulls and NaN of ``target`` by a linear regression on numeric features.

    Rows with a missing feature (null or NaN) keep their gap, as a null; so do all if no
    row has the target and all features. Infinite values take no part in the fit.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    features = as_list(features)
    values = {c: cells.clean_number(c) for c in [target, *features]}
    names = {c: f"_{i}" for i, c in enumerate(values)}
    finite = cells.all_of(F.abs(v) < float("inf") for v in values.values())
    known = df.where(F.coalesce(finite, F.lit(False))).select(*[v.alias(names[c]) for c, v in values.items()])
    assemble = VectorAssembler(inputCols=[names[f] for f in features], outputCol="_x")
    kind = df.schema[target].dataType
    own = cells.known(target, kind)
    if known.isEmpty():
        return df.withColumn(target, own)
    model = LinearRegression(featuresCol="_x", labelCol=names[target], predictionCol="_y").fit(assemble.transform(known))
    guess = F.lit(float(model.intercept))
    for f, w in zip(features, model.coefficients):
        guess = guess + values[f] * F.lit(float(w))
    return df.withColumn(target, F.coalesce(own, guess))


def impute_columns(df: DataFrame, columns, strategy: str = "mean") -> DataFrame:
    """Imputer of the ML library over numeric columns, in place."""
    from pyspark.ml.feature import Imputer

    cols = as_list(columns)
    model = Imputer(strategy=strategy, inputCols=cols, outputCols=[f"{c}__filled" for c in cols])
    out = model.fit(df).transform(df)
    return out.drop(*cols).withColumnsRenamed({f"{c}__filled": c for c in cols}).select(*df.columns)


def missing_flags(df: DataFrame, columns=None, order_by=()) -> DataFrame:
    """Add ``{column}__is_missing`` as 0 / 1."""
    types = {f.name: f.dataType for f in df.schema}
    cols = columns or data_columns(df, order_by)
    return df.withColumns(
        {f"{c}__is_missing": cells.is_missing(c, types[c]).cast("int") for c in cols}
    )
