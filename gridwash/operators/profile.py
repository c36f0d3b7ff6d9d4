"""Profiles of a table: shape, gaps, repeats, types, samples, outliers.

Counting operators are one wide aggregate over the table, turned into one row per
column afterwards. ``order_by`` names the order column(s); they are not data.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridwash.functions import cells, formats, rules
from gridwash.operators.quantiles import exact_quantiles, number
from gridwash.operators.sampling import (
    as_list,
    data_columns,
    first_distinct,
    numeric_columns,
    sampled,
    sampled_rows,
    text_columns,
    unpivot_text,
)

FACT_SAMPLE = 100
FACT_SCHEMA = (
    "sampled long, padded_10 boolean, padded_20 boolean, padded_100 boolean, distinct_raw int, "
    "distinct_lower int, all_dates boolean, all_numbers boolean, content_format string, n_number long, n_date long, n_text long"
)


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema}


def _missing(df: DataFrame, columns) -> dict[str, Column]:
    types = _types(df)
    return {c: cells.is_missing(c, types[c]) for c in columns}


def per_column(df: DataFrame, columns, measures: dict, whole: dict | None = None) -> DataFrame:
    """One row per column out of ONE wide aggregate.

    ``measures`` maps a name to ``f(column_name) -> aggregate``; ``whole`` holds
    table-level aggregates repeated on every row.
    """
    columns = list(columns)
    whole = whole or {}
    if not columns:
        fields = [f"{n} bigint" for n in whole] + ["column string"]
        fields += [f"{n} double" for n in measures]
        return df.sparkSession.createDataFrame([], ", ".join(fields))
    aggs = [agg.alias(name) for name, agg in whole.items()]
    for i, c in enumerate(columns):
        aggs += [f(c).alias(f"_{name}_{i}") for name, f in measures.items()]
    row = df.agg(*aggs)
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"_{name}_{i}").alias(name) for name in measures],
        )
        for i, c in enumerate(columns)
    ]
    return row.select(*whole, F.inline(F.array(*structs)))


def side_by_side(parts) -> DataFrame:
    """Put one-row results into one row: a union of the parts, then one aggregate."""
    parts = list(parts)
    names = [c for p in parts for c in p.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.first(cells.column(c), ignorenulls=True).alias(c) for c in names])


def table_shape(df: DataFrame, order_by=()) -> DataFrame:
    """rows, columns, total_cells."""
    n = len(data_columns(df, order_by))
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(n).alias("columns"), (F.col("rows") * n).alias("total_cells")
    )


def missing_by_column(df: DataFrame, order_by=()) -> DataFrame:
    """column, missing_count, missing_percent."""
    cols = data_columns(df, order_by)
    miss = _missing(df, cols)
    out = per_column(
        df, cols, {"missing_count": lambda c: F.count_if(miss[c])}, {"rows": F.count("*")}
    )
    return out.select(
        "column",
        "missing_count",
        F.try_divide(F.col("missing_count") * 100.0, F.col("rows")).alias("missing_percent"),
    )


def missing_overall(df: DataFrame, order_by=()) -> DataFrame:
    """missing_cells, total_cells, missing_percent."""
    cols = data_columns(df, order_by)
    per_row = sum((m.cast("long") for m in _missing(df, cols).values()), F.lit(0).cast("long"))
    counts = df.agg(
        F.coalesce(F.sum(per_row), F.lit(0).cast("long")).alias("missing_cells"),
        (F.count("*") * len(cols)).alias("total_cells"),
    )
    return counts.withColumn(
        "missing_percent",
        F.coalesce(
            F.try_divide(F.col("missing_cells") * 100.0, F.col("total_cells")), F.lit(0.0)
        ),
    )


def repeat_counts(df: DataFrame, order_by=(), digest: bool = True) -> DataFrame:
    """Row groups with their size ``copies`` (null equals null and NaN).

    Copies collapse map-side before the shuffle, so a row that fills a third of the
    table costs one row per task. Rows are grouped by a 256-bit digest, so mostly
    distinct rows move 32 bytes each; ``digest=False`` keeps the columns.
    """
    cols = data_columns(df, order_by)
    types = _types(df)
    if digest:
        row = cells.row_json(types, cols)
        return df.groupBy(F.unhex(F.sha2(row, 256)).alias("digest")).agg(
            F.count("*").alias("copies")
        )
    return df.groupBy(*[cells.known(c, types[c]).alias(c) for c in cols]).agg(
        F.count("*").alias("copies")
    )


def duplicate_rows(df: DataFrame, order_by=(), digest: bool = True) -> DataFrame:
    """duplicate_rows: repeats after the first."""
    return repeat_counts(df, order_by, digest).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0).cast("long")).alias("duplicate_rows")
    )


def any_defects(df: DataFrame, order_by=()) -> DataFrame:
    """any_duplicates, any_nulls: both from the grouped rows, in one pass over the table."""
    cols = data_columns(df, order_by)
    return repeat_counts(df, order_by, False).agg(
        F.coalesce(F.max(F.col("copies") > 1), F.lit(False)).alias("any_duplicates"),
        F.coalesce(F.max(cells.any_of(_missing(df, cols).values())), F.lit(False)).alias(
            "any_nulls"
        ),
    )


def unique_count(df: DataFrame, order_by=(), columns=None, approx: bool = False) -> DataFrame:
    """column, unique_count of non-null values.

    Exact counts go through (column, value) groups, which collapse map-side and
    spread over the cluster; ``approx`` is a single sketch pass.
    """
    cols = list(columns or data_columns(df, order_by))
    if approx:
        return per_column(
            df, cols, {"unique_count": lambda c: F.approx_count_distinct(cells.column(c))}
        )
    counted = (
        unpivot_text(df, cols).distinct().groupBy("column").agg(F.count("*").alias("unique_count"))
    )
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counted, "column", "left").select(
        "column", F.coalesce("unique_count", F.lit(0).cast("long")).alias("unique_count")
    )


def _single_value(c: str, types) -> Column:
    """min = max: one value and no shuffle, unlike a distinct count."""
    v = F.when(~cells.is_missing(c, types[c]), cells.column(c))
    return F.coalesce(F.min(v) == F.max(v), F.lit(False))


def single_value_columns(df: DataFrame, order_by=()) -> DataFrame:
    """column: those with exactly one distinct non-null value."""
    types = _types(df)
    cols = data_columns(df, order_by)
    flags = per_column(df, cols, {"single_value": lambda c: _single_value(c, types)})
    return flags.where("single_value").select("column")


def empty_counts(df: DataFrame, order_by=()) -> DataFrame:
    """empty_rows, empty_columns (null-only)."""
    cols = data_columns(df, order_by)
    miss = _missing(df, cols)
    row = df.agg(
        F.count_if(cells.all_of(miss.values())).alias("empty_rows"),
        *[F.count_if(~miss[c]).alias(f"_n{i}") for i, c in enumerate(cols)],
    )
    empty = sum(((F.col(f"_n{i}") == 0).cast("long") for i in range(len(cols))), F.lit(0).cast("long"))
    return row.select("empty_rows", empty.alias("empty_columns"))


def numeric_stats(df: DataFrame, order_by=()) -> DataFrame:
    """column, min, max, mean, rounded to two decimals; NaN is missing."""
    cols = numeric_columns(df, order_by)
    types = _types(df)
    return per_column(
        df,
        cols,
        {
            "min": lambda c: F.round(F.min(cells.known(c, types[c])).cast("double"), 2),
            "max": lambda c: F.round(F.max(cells.known(c, types[c])).cast("double"), 2),
            "mean": lambda c: F.round(F.avg(cells.known(c, types[c])).cast("double"), 2),
        },
    )


def describe(df: DataFrame, order_by=()) -> DataFrame:
    """count, mean, std, min, quartiles, max of every numeric column (exact quartiles)."""
    cols = numeric_columns(df, order_by)
    quartiles = exact_quantiles(df, cols, (0.25, 0.5, 0.75))

    def q(i):
        return lambda c: F.first(F.lit(quartiles[c][i]).cast("double"))

    num = cells.clean_number

    return per_column(
        df,
        cols,
        {
            "count": lambda c: F.count(num(c)),
            "mean": lambda c: F.avg(num(c)),
            "std": lambda c: F.stddev_samp(num(c)),
            "min": lambda c: F.min(num(c)),
            "q25": q(0),
            "q50": q(1),
            "q75": q(2),
            "max": lambda c: F.max(num(c)),
        },
    )


def describe_dates(df: DataFrame, order_by=()) -> DataFrame:
    """count, mean, min, quartiles, max of every date or time column, as timestamps.

    Times are numbers of microseconds in between; quartiles are exact.
    """
    cols = [c for c in data_columns(df, order_by) if type_kind(df.schema[c].dataType) == "datetime"]

    def micros(c):
        return F.unix_micros(F.to_timestamp(cells.column(c).cast("timestamp_ntz")))

    numbers = describe(df.select(*[micros(c).cast("double").alias(c) for c in cols]))

    def time(c):
        return F.timestamp_micros(F.round(c).cast("long")).cast("timestamp_ntz").alias(c)

    return numbers.select("column", "count", *[time(c) for c in ("mean", "min", "q25", "q50", "q75", "max")])


def type_kind(dtype: T.DataType) -> str:
    """numeric / text / datetime / other."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


def type_counts(df: DataFrame, order_by=()) -> DataFrame:
    """dtype, kind, columns: how many columns of each type."""
    keep = set(data_columns(df, order_by))
    rows = [
        (f.dataType.simpleString(), type_kind(f.dataType)) for f in df.schema if f.name in keep
    ]
    return (
        df.sparkSession.createDataFrame(rows, "dtype string, kind string")
        .groupBy("dtype", "kind")
        .agg(F.count("*").alias("columns"))
    )


def sample_values(df: DataFrame, order_by, k: int = 5, distinct: bool = False) -> DataFrame:
    """column, samples: the first k non-null (or distinct) values as text."""
    cols = data_columns(df, order_by)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    values = F.transform(ordered, lambda s: s["value"]).alias("samples")
    if distinct:
        return first_distinct(df, cols, order_by, k).groupBy("column").agg(values)
    return sampled(df, cols, order_by, k, [values])


def content_format(in_sample: Column) -> Column:
    """Aggregate: the format that the sampled ``value`` column speaks for, or null."""
    pick = F.lit(None).cast("string")
    for fmt, _, share in reversed(rules.CONTENT_RULES):
        hits = F.count_if(in_sample & formats.content_hit(fmt, "value"))
        pick = F.when(hits > F.count_if(in_sample) * share, F.lit(fmt)).otherwise(pick)
    return pick


def _decided() -> list[Column]:
    """Aggregates over pos and value: what the first 10 / 20 / 100 values of a column tell."""
    v, pos = F.col("value"), F.col("pos")
    in20 = pos <= 20
    numeric, date = cells.is_number(v), cells.is_date(v)
    padded = v != cells.trim_text(v)
    return [
        F.count_if(in20).alias("sampled"),
        F.max((pos <= 10) & padded).alias("padded_10"),
        F.max(in20 & padded).alias("padded_20"),
        F.max(padded).alias("padded_100"),
        F.size(F.collect_set(F.when(in20, v))).alias("distinct_raw"),
        F.size(F.collect_set(F.when(in20, F.lower(v)))).alias("distinct_lower"),
        F.min(~in20 | cells.is_date_text(v)).alias("all_dates"),
        F.min(~in20 | cells.is_plain_number(v)).alias("all_numbers"),
        content_format(in20).alias("content_format"),
        F.count_if(in20 & numeric).alias("n_number"),
        F.count_if(in20 & date).alias("n_date"),
        (F.count_if(in20) - F.count_if(in20 & numeric) - F.count_if(in20 & date)).alias("n_text"),
    ]


def sample_facts(df: DataFrame, order_by, columns=None) -> DataFrame:
    """Everything that is decided on the first 10 / 20 / 100 values, one row per column."""
    cols = list(columns if columns is not None else text_columns(df, order_by))
    return sampled(df, cols, order_by, FACT_SAMPLE, _decided())


class TableFacts:
    """What one table's profile, suggestions and score are worked out from, each part
    measured once and when it is first asked for: one wide aggregate, one sample, one row
    grouping. All of it is small, one row per column, and stays on the driver; pass the
    object on instead of measuring again.
    """

    def __init__(self, df: DataFrame, order_by=(), with_memory: bool = False):
        self.df, self.order_by, self.with_memory = df, order_by, with_memory
        self.columns = data_columns(df, order_by)
        self.types = _types(df)

    @functools.cached_property
    def _wide(self):
        miss = _missing(self.df, self.columns)
        aggs = [
            F.count("*").alias("rows"),
            F.count_if(cells.all_of(miss.values())).alias("empty_rows"),
        ]
        if self.with_memory:
            aggs.append(_json_bytes(self.columns).alias("bytes"))
        for i, c in enumerate(self.columns):
            aggs += [F.count_if(miss[c]).alias(f"m{i}"), _single_value(c, self.types).alias(f"s{i}")]
            if isinstance(self.types[c], T.NumericType):
                known = cells.known(c, self.types[c])
                stats = {"low": F.min(known), "high": F.max(known), "mean": F.avg(known)}
                aggs += [v.cast("double").alias(f"{k}{i}") for k, v in stats.items()]
        return self.df.agg(*aggs).first()

    def _of(self, name: str) -> dict:
        return {c: self._wide[f"{name}{i}"] for i, c in enumerate(self.columns) if f"{name}{i}" in self._wide}

    @property
    def rows(self) -> int:
        return self._wide["rows"]

    @property
    def empty_rows(self) -> int:
        return self._wide["empty_rows"]

    @functools.cached_property
    def logical_bytes(self) -> int:
        if self.with_memory:
            return self._wide["bytes"] or 0
        return memory_usage(self.df, self.order_by).first()[0]

    @functools.cached_property
    def missing(self) -> dict[str, int]:
        return self._of("m")

    @functools.cached_property
    def values(self) -> dict[str, int]:
        """Non-missing cells of each column."""
        return {c: self.rows - n for c, n in self.missing.items()}

    @functools.cached_property
    def single(self) -> dict[str, bool]:
        return self._of("s")

    @functools.cached_property
    def ranges(self) -> dict[str, tuple]:
        """{numeric column: (min, max, mean)}."""
        low, high, mean = self._of("low"), self._of("high"), self._of("mean")
        return {c: (low[c], high[c], mean[c]) for c in low}

    @functools.cached_property
    def sample(self) -> dict:
        """{column: row of :func:`sample_facts`} of the columns that have values."""
        rows, _ = sampled_rows(self.df, self.columns, self.order_by, FACT_SAMPLE, _decided(), self.values)
        return {r["column"]: r for r in rows}

    @functools.cached_property
    def repeats(self) -> int:
        return duplicate_rows(self.df, self.order_by).first()[0]

    def column_rows(self) -> DataFrame:
        """column, rows, missing, single and, of text columns, the fields of
        :func:`sample_facts`: one row per column, from what is known."""
        names = [f.split()[0] for f in FACT_SCHEMA.split(", ")]
        texts = set(text_columns(self.df, self.order_by))
        known = []
        for c in self.columns:
            fact = self.sample.get(c) if c in texts else None
            decided = [fact[n] for n in names] if fact else [None] * len(names)
            known.append((c, self.rows, self.missing[c], bool(self.single[c]), *decided))
        return self.df.sparkSession.createDataFrame(known, f"column string, rows long, missing long, single boolean, {FACT_SCHEMA}")

    def repeat_row(self) -> DataFrame:
        """duplicate_rows, as one row."""
        return self.df.sparkSession.createDataFrame([(self.repeats,)], "duplicate_rows long")


def whitespace_columns(df: DataFrame, order_by, k: int = 10) -> DataFrame:
    """column: text columns with a padded value among the first k (any k)."""
    padded = F.max(F.col("value") != cells.trim_text("value")).alias("padded")
    return sampled(df, text_columns(df, order_by), order_by, k, [padded]).where("padded").select("column")


def inconsistent_case_columns(df: DataFrame, order_by) -> DataFrame:
    """column, distinct_raw, distinct_lower for text columns whose case varies."""
    return (
        sample_facts(df, order_by)
        .where("distinct_lower < distinct_raw")
        .select(
            "column",
            F.col("distinct_raw").cast("long").alias("distinct_raw"),
            F.col("distinct_lower").cast("long").alias("distinct_lower"),
        )
    )


def potentially_datetime(df: DataFrame, order_by) -> DataFrame:
    """column: text columns whose first 20 values all parse as dates."""
    return sample_facts(df, order_by).where("all_dates").select("column")


def potentially_numeric_text(df: DataFrame, order_by) -> DataFrame:
    """column: text columns, not datetime-like, whose first 20 values are all numbers."""
    return sample_facts(df, order_by).where("all_numbers AND NOT all_dates").select("column")


def high_missing_columns(df: DataFrame, order_by=(), threshold: float = 0.5) -> DataFrame:
    """column, missing_percent above the threshold."""
    out = missing_by_column(df, order_by)
    return out.where(F.col("missing_percent") > threshold * 100).select("column", "missing_percent")


def mixed_type_columns(df: DataFrame, order_by, mixed_basis: str = "all") -> DataFrame:
    """column, n_number, n_date, n_text, non_null, severe.

    ``severe`` compares the 20-row counts with 20 % of all non-null rows;
    ``mixed_basis="sample"`` compares with the sampled rows instead.
    """
    cols = text_columns(df, order_by)
    miss = _missing(df, cols)
    totals = per_column(df, cols, {"non_null": lambda c: F.count_if(~miss[c])})
    facts = sample_facts(df, order_by, cols).select(
        "column", "n_number", "n_date", "n_text", "sampled"
    )
    kinds = [F.col(c) for c in ("n_number", "n_date", "n_text")]
    basis = F.col("sampled") if mixed_basis == "sample" else F.col("non_null")
    severe = (F.col("non_null") > 1) & cells.all_of((k > 0) & (k > basis * 0.2) for k in kinds)
    return facts.join(totals, "column").select(
        "column", "n_number", "n_date", "n_text", "non_null", severe.alias("severe")
    )


def _json_bytes(columns) -> Column:
    rows = F.octet_length(F.to_json(F.struct(*[cells.column(c) for c in columns])))
    return F.coalesce(F.sum(rows).cast("long"), F.lit(0).cast("long"))


def memory_usage(df: DataFrame, order_by=()) -> DataFrame:
    """logical_bytes: size of the rows as JSON text, an engine-neutral estimate."""
    return df.agg(_json_bytes(data_columns(df, order_by)).alias("logical_bytes"))


def iqr_bounds(df: DataFrame, columns, factor: float) -> dict[str, tuple[float, float]]:
    """{column: (low, high)} for columns with a positive interquartile range."""
    out = {}
    for c, (q1, q3) in exact_quantiles(df, columns, (0.25, 0.75)).items():
        if q1 is not None and q3 - q1 > 0:
            out[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def outlier_ratio(df: DataFrame, order_by=(), factor: float = rules.SCORE_OUTLIER_IQR) -> DataFrame:
    """column, n_values, n_outliers, outlier_ratio per numeric column with a positive IQR."""
    bounds = iqr_bounds(df, numeric_columns(df, order_by), factor)
    if not bounds:
        return df.sparkSession.createDataFrame(
            [], "column string, n_values bigint, n_outliers bigint, outlier_ratio double"
        )

    out = per_column(
        df,
        bounds,
        {
            "n_values": lambda c: F.count(number(c)),
            "n_outliers": lambda c: F.count_if(
                (number(c) < F.lit(bounds[c][0])) | (number(c) > F.lit(bounds[c][1]))
            ),
        },
    )
    return out.where("n_values > 1").withColumn(
        "outlier_ratio", F.col("n_outliers") / F.col("n_values")
    )


def flag_outliers(
    df: DataFrame, order_by=(), factor: float = rules.FLAG_OUTLIER_IQR, columns=None
) -> DataFrame:
    """The table plus ``{column}__outlier``; no row is removed."""
    cols = list(columns or numeric_columns(df, order_by))
    bounds = iqr_bounds(df, cols, factor)

    def flag(c):
        if c not in bounds:
            return F.lit(False)
        low, high = bounds[c]
        v = cells.clean_number(c)
        return F.coalesce((v < F.lit(low)) | (v > F.lit(high)), F.lit(False))

    return df.withColumns({f"{c}__outlier": flag(c) for c in cols})


def _distinct_values(df: DataFrame, columns, order_by, k: int) -> DataFrame:
    """column, unique_count, samples: how many values each column has, and the first k.

    One grouping of all cells by (column, value) serves both: it collapses map-side and
    spreads over the cluster. Of its groups each task keeps k per column.
    """
    keys = [f"_o{i}" for i in range(len(order_by))]
    ordered = df.select(*[cells.column(o).alias(n) for o, n in zip(order_by, keys)], *[cells.column(c) for c in columns])
    # One order column stays a plain value: a hash aggregate instead of a sort.
    place = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    groups = unpivot_text(ordered, columns, keep=keys).groupBy("column", "value").agg(F.min(place).alias("first_seen"))
    pos = F.row_number().over(Window.partitionBy("column").orderBy("first_seen", "value"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("samples")
    firsts = groups.withColumn("pos", pos).where(F.col("pos") <= k).groupBy("column").agg(listed)
    return groups.groupBy("column").agg(F.count("*").alias("unique_count")).join(firsts, "column")


def column_profile(
    df: DataFrame, order_by, max_columns: int | None = None, facts: TableFacts | None = None
) -> DataFrame:
    """One row per column: counts, gaps, distinct values, samples, flags, number range."""
    facts = facts or TableFacts(df, order_by)
    cols = facts.columns[:max_columns]
    known = []
    for c in cols:
        fact = facts.sample.get(c) if isinstance(facts.types[c], T.StringType) else None
        kinds = [fact[k] for k in ("n_number", "n_date", "n_text")] if fact else [0]
        n = facts.values[c]
        severe = n > 1 and all(k > 0 and k > n * 0.2 for k in kinds)
        low, high, mean = facts.ranges.get(c, (None, None, None))
        known.append(
            (c, facts.types[c].simpleString(), facts.rows, n, facts.missing[c], bool(fact and fact["padded_100"]), severe, low, high, mean)
        )
    base = df.sparkSession.createDataFrame(
        known,
        "column string, dtype string, total_count long, non_null_count long, missing_count long, "
        "has_whitespace_issues boolean, has_mixed_types boolean, min double, max double, mean double",
    )
    percent = F.round(F.try_divide(F.col("missing_count") * 100.0, F.col("total_count")), 2)
    return base.join(_distinct_values(df, cols, as_list(order_by), 5), "column", "left").select(
        "column",
        "dtype",
        "total_count",
        "non_null_count",
        "missing_count",
        percent.alias("missing_percent"),
        F.coalesce("unique_count", F.lit(0).cast("long")).alias("unique_count"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        "has_whitespace_issues",
        "has_mixed_types",
        *[F.round(c, 2).alias(c) for c in ("min", "max", "mean")],
    )


def generate_metadata(df: DataFrame, order_by, facts: TableFacts | None = None) -> DataFrame:
    """One record: shape, columns, types, gaps, size, repeats and quality indicators."""
    facts = facts or TableFacts(df, order_by, with_memory=True)
    cols, types, n = facts.columns, facts.types, facts.rows
    texts = [facts.sample[c] for c in text_columns(df, order_by) if c in facts.sample]
    dates = sorted(r["column"] for r in texts if r["all_dates"])
    numbers = sorted(r["column"] for r in texts if r["all_numbers"] and not r["all_dates"])
    sparse = sorted(c for c in cols if n and facts.missing[c] * 100.0 / n > 50)
    row = (n, len(cols), n * len(cols), facts.missing, sparse, facts.repeats, facts.logical_bytes, dates, numbers, cols)
    record = df.sparkSession.createDataFrame(
        [(*row, {c: types[c].simpleString() for c in cols})],
        "rows long, columns int, total_cells long, missing_values map<string,long>, high_missing_columns array<string>, "
        "duplicate_rows long, logical_bytes long, potentially_datetime array<string>, potentially_numeric_text array<string>, "
        "column_names array<string>, dtypes map<string,string>",
    )
    return record


def quality_issues(df: DataFrame, order_by, facts: TableFacts | None = None) -> DataFrame:
    """issue_ord, column, issue: text lines in the order an analyst would read them."""
    facts = facts or TableFacts(df, order_by)
    position = F.create_map(*[x for i, c in enumerate(facts.columns) for x in (F.lit(c), F.lit(i))])
    joined = facts.column_rows()
    percent = F.try_divide(F.col("missing") * 100.0, F.col("rows"))
    name, said = F.col("column"), rules.ISSUE_TEXTS

    def line(ord_, cond, template, *args):
        return F.when(
            F.coalesce(cond, F.lit(False)),
            F.struct(
                F.lit(ord_).alias("rule"), F.format_string(template, name, *args).alias("issue")
            ),
        )

    lines = F.array_compact(
        F.array(
            line(0, percent > 50, said["missing"], percent),
            line(1, F.col("single"), said["single"]),
            line(2, F.col("padded_10"), said["padding"]),
            line(4, F.col("all_dates"), said["dates"]),
            line(
                5,
                F.col("all_numbers") & ~F.col("all_dates"),
                said["numbers"],
            ),
        )
    )
    per_col = joined.select("column", F.inline(lines)).select(
        F.when(F.col("rule") < 3, position[name] * 10 + F.col("rule"))
        .otherwise(F.col("rule") * 1_000_000 + position[name])
        .alias("issue_ord"),
        "column",
        "issue",
    )
    repeats = facts.repeat_row().where("duplicate_rows > 0").select(
        F.lit(3_000_000).alias("issue_ord"),
        F.lit(None).cast("string").alias("column"),
        F.format_string(said["repeats"], F.col("duplicate_rows")).alias("issue"),
    )
    return per_col.unionByName(repeats)


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """stage, rows, columns, score for two score rows (see ``score.quality_report``)."""
    keep = ["rows", "columns", "score"]
    return before.select(F.lit("before").alias("stage"), *keep).unionByName(
        after.select(F.lit("after").alias("stage"), *keep)
    )
