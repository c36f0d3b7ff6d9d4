"""Whole-column conversions that first decide, then convert.

The decision is one aggregate (one small row to the driver); the conversion is a
projection. Only date conversion may lose text, and ``on_unparsed`` rules it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwash.functions import cells, formats, rules
from gridwash.operators.sampling import sampled, text_columns


def _decide(df: DataFrame, measures: dict) -> dict:
    """Run every aggregate of ``{(column, name): aggregate}`` in one job."""
    keys = list(measures)
    if not keys:
        return {}
    row = df.agg(*[measures[k].alias(f"_{i}") for i, k in enumerate(keys)]).first()
    return {k: row[f"_{i}"] for i, k in enumerate(keys)}


def map_text(df: DataFrame, f, order_by=(), columns=None) -> DataFrame:
    """Apply a Column function to text columns: one projection."""
    cols = list(columns if columns is not None else text_columns(df, order_by))
    return df.withColumns({c: f(cells.column(c)) for c in cols})


def trim_all(df: DataFrame, order_by=()) -> DataFrame:
    return map_text(df, cells.trim_text, order_by)


def null_all_tokens(df: DataFrame, order_by=()) -> DataFrame:
    return map_text(df, cells.null_tokens, order_by)


def case_all(df: DataFrame, mode: str = "title", order_by=()) -> DataFrame:
    return map_text(df, lambda c: cells.case_text(c, mode), order_by)


def fill_missing(df: DataFrame, value: str = "", order_by=()) -> DataFrame:
    """Fill text columns; typed columns keep their nulls and their type."""
    return map_text(df, lambda c: F.coalesce(c, F.lit(value)), order_by)


def missing_mask(df: DataFrame, order_by=()) -> DataFrame:
    """The table plus ``{column}__missing`` flags."""
    keys = {order_by} if isinstance(order_by, str) else set(order_by)
    return df.withColumns(
        {
            f"{f.name}__missing": cells.is_missing(f.name, f.dataType)
            for f in df.schema
            if f.name not in keys
        }
    )


def numeric_ready(df: DataFrame, order_by=(), columns=None) -> list[str]:
    """Text columns whose every non-null value is a plain number (at least one)."""
    cols = list(columns if columns is not None else text_columns(df, order_by))
    m = {}
    for c in cols:
        m[c, "n"] = F.count(cells.column(c))
        m[c, "bad"] = F.count_if(~cells.is_plain_number(c))
    got = _decide(df, m)
    return [c for c in cols if got[c, "n"] > 0 and got[c, "bad"] == 0]


def to_numeric_safe(df: DataFrame, order_by=(), columns=None) -> DataFrame:
    """Columns in which every non-null value parses become double; others stay."""
    ready = numeric_ready(df, order_by, columns)
    return df.withColumns({c: cells.to_number(c) for c in ready})


def with_dates(df: DataFrame, columns, day_first: bool = True) -> DataFrame:
    """Add ``_date_i`` with the parsed i-th column, computed once per cell."""
    return df.withColumns(
        {f"_date_{i}": cells.parse_datetime(c, day_first) for i, c in enumerate(columns)}
    )


def _date_counts(df: DataFrame, columns, day_first: bool) -> dict:
    """{column: row with n_rows, n_values, n_dates}.

    Cells are unpivoted, so the generated code holds one parser for all columns and
    stays small enough to be compiled; counts combine map-side.
    """
    pairs = [F.struct(F.lit(c).alias("column"), cells.column(c).alias("value")) for c in columns]
    counted = (
        df.select(F.inline(F.array(*pairs)))
        .groupBy("column")
        .agg(
            F.count("*").alias("n_rows"),
            F.count("value").alias("n_values"),
            F.count(cells.parse_datetime("value", day_first)).alias("n_dates"),
        )
    )
    return {r["column"]: r for r in counted.collect()}


def datetime_ready(df: DataFrame, order_by=(), columns=None, day_first: bool = False) -> list[str]:
    """Text columns in which more than half of ALL rows parse as dates."""
    cols = list(columns if columns is not None else text_columns(df, order_by))
    if not cols:
        return []
    got = _date_counts(df, cols, day_first)
    return [c for c in cols if c in got and got[c]["n_dates"] > got[c]["n_rows"] * 0.5]


def to_datetime_safe(
    df: DataFrame, order_by=(), columns=None, day_first: bool = False, on_unparsed: str = "null"
) -> DataFrame:
    """Columns that are mostly dates become timestamps.

    Unparsed text becomes null, or with ``on_unparsed="keep"`` a column that holds any
    stays text.
    """
    ready = datetime_ready(df, order_by, columns, day_first)
    if on_unparsed == "keep" and ready:
        got = _date_counts(df, ready, day_first)
        ready = [c for c in ready if got[c]["n_dates"] == got[c]["n_values"]]
    return (
        with_dates(df, ready, day_first)
        .withColumns({c: F.col(f"_date_{i}") for i, c in enumerate(ready)})
        .select(*[cells.column(c) for c in df.columns])
    )


def date_columns(df: DataFrame, order_by, columns=None) -> list[str]:
    """Text columns under 80 % null with a date-like early value and mostly parsable."""
    cols = list(columns if columns is not None else text_columns(df, order_by))
    v = F.col("value")
    like_date = F.max(cells.any_of(v.rlike(p) for p in rules.DATE_COLUMN_SEARCH)).alias("hit")
    seen = sampled(df, cols, order_by, 20, [F.count("*").alias("n"), like_date])
    hits = {r["column"] for r in seen.where("n >= 3 AND hit").collect()}
    cols = [c for c in cols if c in hits]
    if not cols:
        return []
    got = _date_counts(df, cols, True)
    return [
        c
        for c in cols
        if got[c]["n_rows"] - got[c]["n_values"] <= got[c]["n_rows"] * 0.8
        and got[c]["n_dates"] > got[c]["n_values"] * 0.5
    ]


def standardize_dates(
    df: DataFrame,
    order_by,
    columns=None,
    date_out: str = "yyyy/MM/dd",
    on_unparsed: str = "keep",
) -> DataFrame:
    """Rewrite date columns (day-first reading) to one text form.

    Unparsed text stays (``keep``) or becomes null (``null``).
    """
    ready = date_columns(df, order_by, columns)

    def rewrite(i, c):
        parsed = F.date_format(f"_date_{i}", date_out)
        return F.coalesce(parsed, cells.column(c)) if on_unparsed == "keep" else parsed

    return (
        with_dates(df, ready)
        .withColumns({c: rewrite(i, c) for i, c in enumerate(ready)})
        .select(*[cells.column(c) for c in df.columns])
    )


# --- fixed values: column kinds recognised for rewriting, first past 70 % wins ------
KIND_SHARE = 0.7
KIND_PATTERNS = (
    ("date", None),
    ("email", rules.PATTERNS["EMAIL"][0]),
    ("time", rules.TIME_OF_DAY),
    ("credit_card", rules.PATTERNS["CREDIT_CARD"][0]),
    ("ssn", r"^\d{3}-\d{2}-\d{4}$"),
    ("phone", r"^(\+\d{1,3}[-\s]?)?\(?\d{2,5}\)?[-\s]?\d{3,5}[-\s]?\d{4,5}$"),
    ("zip", r"^\d{5,6}(-\d{4})?$"),
    ("percentage", r"^\d{1,3}(\.\d+)?\s?%$"),
    ("currency", r"^[₹$€£¥]\s?\d[\d,]*(\.\d+)?$"),
)


def column_kinds(df: DataFrame, order_by, columns=None) -> dict[str, str]:
    """{column: kind} for text columns under 80 % null with at least 3 sampled values."""
    cols = list(columns if columns is not None else text_columns(df, order_by))
    if not cols:
        return {}
    v = cells.trim_text("value")

    def hit(kind, pattern):
        return cells.parse_datetime(v).isNotNull() if kind == "date" else v.rlike(pattern)

    pick = F.lit(None).cast("string")
    for kind, pattern in reversed(KIND_PATTERNS):
        share = F.count_if(hit(kind, pattern)) / F.count("*")
        pick = F.when(share > KIND_SHARE, F.lit(kind)).otherwise(pick)
    seen = sampled(df, cols, order_by, 20, [F.count("*").alias("n"), pick.alias("kind")])
    kinds = {r["column"]: r["kind"] for r in seen.where("n >= 3 AND kind IS NOT NULL").collect()}
    got = _decide(
        df,
        {("all", "rows"): F.count("*"), **{(c, "n"): F.count(cells.column(c)) for c in kinds}},
    )
    rows = got["all", "rows"]
    return {c: k for c, k in kinds.items() if rows - got[c, "n"] <= rows * 0.8}


def rewrite_kind(c, kind: str):
    """Standard text of one kind; text that does not fit stays as it is."""
    col = cells.column(c)
    text = cells.trim_text(col)
    if kind == "date":
        return F.coalesce(F.date_format(cells.parse_datetime(text), "yyyy/MM/dd"), col)
    if kind == "percentage":
        number = F.regexp_extract(text, r"^(\d{1,3}(?:\.\d+)?)\s?%$", 1).try_cast("double")
        return F.when(number.isNotNull(), F.format_string("%.2f%%", number)).otherwise(col)
    if kind == "currency":
        sign = F.substring(text, 1, 1)
        amount = F.when(
            text.rlike(r"^[₹$€£¥]\s?\d[\d,]*(\.\d+)?$"),
            F.translate(text, "₹$€£¥, ", "").try_cast("double"),
        )
        return F.coalesce(F.concat(sign, F.format_number(amount, 2)), col)
    if kind == "phone":
        digits = F.regexp_replace(text, r"\D", "")
        full = F.when(digits.rlike(r"^\d{12}$"), digits).when(
            digits.rlike(r"^[6-9]\d{9}$"), F.concat(F.lit("91"), digits)
        )
        return F.coalesce(
            F.regexp_replace(full, r"^(\d{2})(\d{4})(\d{6})$", r"+$1 $2 $3"), col
        )
    return text


def standardize_by_format(df: DataFrame, order_by, columns=None) -> DataFrame:
    """Recognise each text column's kind and rewrite it to that kind's standard form."""
    kinds = column_kinds(df, order_by, columns)
    return df.withColumns({c: rewrite_kind(c, k) for c, k in kinds.items()})


def standardize_column(df: DataFrame, column: str, fmt: str) -> DataFrame:
    return df.withColumn(column, formats.standardize_value(column, fmt))
