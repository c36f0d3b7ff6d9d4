"""Rows, columns and headers.

Emptiness is decided on text after a strip (``blank=True``) or on nulls only.
Header decisions read a handful of leading rows; the table itself stays lazy.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from gridwash.functions import cells, rules
from gridwash.operators.profile import sample_facts
from gridwash.operators.sampling import as_list, data_columns


def _empty_cell(df: DataFrame, c: str, blank: bool) -> Column:
    test = cells.is_blank if blank else cells.is_missing
    return test(c, df.schema[c].dataType)


def drop_empty_rows(df: DataFrame, order_by=(), blank: bool = True) -> DataFrame:
    """Drop rows whose every data cell is empty."""
    cols = data_columns(df, order_by)
    return df.where(~cells.all_of(_empty_cell(df, c, blank) for c in cols))


def drop_null_rows(df: DataFrame, order_by=()) -> DataFrame:
    return drop_empty_rows(df, order_by, blank=False)


def filled_columns(df: DataFrame, order_by=(), blank: bool = True) -> list[str]:
    """Data columns with at least one non-empty cell (one aggregate)."""
    cols = data_columns(df, order_by)
    row = df.agg(
        *[F.max(~_empty_cell(df, c, blank)).alias(f"_f{i}") for i, c in enumerate(cols)]
    ).first()
    return [c for i, c in enumerate(cols) if row[f"_f{i}"]]


def drop_empty_columns(df: DataFrame, order_by=(), blank: bool = True) -> DataFrame:
    """Drop data columns without a non-empty cell."""
    keep = set(filled_columns(df, order_by, blank)) | set(as_list(order_by) if order_by else [])
    return df.select(*[cells.column(c) for c in df.columns if c in keep])


def drop_null_columns(df: DataFrame, order_by=()) -> DataFrame:
    return drop_empty_columns(df, order_by, blank=False)


def headers_are_good(columns) -> bool:
    """Fewer than half of the names generic and fewer than 30 % data-like."""
    names = [str(c).strip() for c in columns]
    if not names:
        return False
    generic = sum(any(re.match(p, n) for p in rules.GENERIC_HEADERS) for n in names)
    data_like = sum(_name_looks_like_data(n) for n in names)
    return (
        generic / len(names) < rules.GENERIC_SHARE and data_like / len(names) < rules.DATA_LIKE_SHARE
    )


def _name_looks_like_data(name: str) -> bool:
    plain = name.translate({ord(s): None for s in rules.NUMBER_SYMBOLS}).strip()
    return bool(name) and bool(
        re.match(rules.NUMBER, plain)
        or any(re.search(p, name) for p in rules.DATE_SEARCH)
        or len(name) > rules.LONG_TEXT
        or re.match(rules.SYMBOLS_ONLY, name)
    )


def header_quality_of(names: DataFrame, table_key: str, name: str) -> DataFrame:
    """Judge the headers of many tables in one job: one row per (table, column name)."""
    text = F.coalesce(cells.trim_text(name), F.lit(""))
    generic = cells.any_of(text.rlike(p) for p in rules.GENERIC_HEADERS)
    share = lambda c: F.count_if(c) / F.count("*")
    return (
        names.groupBy(cells.column(table_key))
        .agg(
            F.count("*").alias("columns"),
            share(generic).alias("generic_ratio"),
            share(cells.looks_like_data(text)).alias("data_like_ratio"),
        )
        .withColumn(
            "good",
            (F.col("generic_ratio") < rules.GENERIC_SHARE)
            & (F.col("data_like_ratio") < rules.DATA_LIKE_SHARE),
        )
    )


def unique_names(names) -> list[str]:
    """Suffix repeats with _1, _2, ... until every name is free."""
    out, used = [], set()
    for n in names:
        name, k = n, 0
        while name in used:
            k += 1
            name = f"{n}_{k}"
        used.add(name)
        out.append(name)
    return out


def header_names(values, max_length: int | None = None) -> list[str]:
    """Column names from the cells of a header row."""
    names = []
    for i, v in enumerate(values, start=1):
        text = "" if v is None else str(v).strip()
        too_long = max_length is not None and len(text) > max_length
        names.append(f"Column_{i}" if text == "" or too_long else text)
    return unique_names(names)


def _rename_data(df: DataFrame, order_by, names) -> DataFrame:
    mapping = dict(zip(data_columns(df, order_by), names))
    return df.select(*[cells.column(c).alias(mapping.get(c, c)) for c in df.columns])


def leading_rows(df: DataFrame, order_by, n: int) -> list:
    """The first n rows by order column; n is a small constant.

    Two steps: the order value at the n-th place from a one-column scan, then a
    filter that reaches the scan, so only the head of a large table is read whole.
    """
    keys = as_list(order_by)
    head = df.select(*[cells.column(k) for k in keys]).orderBy(*keys).limit(n)
    last = head.agg(F.max(cells.column(keys[0]))).first()[0]
    lead = cells.column(keys[0])
    part = df.where(lead.isNull() | (lead <= F.lit(last))) if last is not None else df
    return part.orderBy(*[cells.column(k) for k in keys]).limit(n).collect()


def _after(df: DataFrame, order_by, row) -> DataFrame:
    """Rows strictly after ``row`` in order (nulls first)."""
    later, same = F.lit(False), F.lit(True)
    for k in as_list(order_by):
        c = cells.column(k)
        if row[k] is None:
            later, same = later | (same & c.isNotNull()), same & c.isNull()
        else:
            later, same = later | (same & (c > F.lit(row[k]))), same & (c == F.lit(row[k]))
    return df.where(F.coalesce(later, F.lit(False)))


def promote_header_row(df: DataFrame, order_by, k: int, max_length=rules.LONG_HEADER) -> DataFrame:
    """Row ``k`` (0-based) becomes the names; rows up to it go."""
    rows = leading_rows(df, order_by, k + 1)
    if len(rows) <= k:
        return df
    header = rows[k]
    names = header_names([header[c] for c in data_columns(df, order_by)], max_length)
    return _rename_data(_after(df, order_by, header), order_by, names)


def promote_first_row(df: DataFrame, order_by, max_length=None) -> DataFrame:
    """The first row becomes the names; blanks become ``Column_i``, repeats get a suffix."""
    return promote_header_row(df, order_by, 0, max_length)


def generate_names(df: DataFrame, order_by=()) -> DataFrame:
    """Column_1 .. Column_n."""
    n = len(data_columns(df, order_by))
    return _rename_data(df, order_by, [f"Column_{i}" for i in range(1, n + 1)])


def row_type_tags(df: DataFrame, order_by, rows: int = rules.HEADER_ROWS) -> DataFrame:
    """row_no, column, tag for the non-blank cells of the leading rows."""
    cols = data_columns(df, order_by)
    head = leading_rows(df, order_by, rows)
    schema = T.StructType([df.schema[c] for c in cols]).add("row_no", T.IntegerType())
    local = df.sparkSession.createDataFrame(
        [tuple(r[c] for c in cols) + (i,) for i, r in enumerate(head)], schema
    )
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(
                ~_empty_cell(df, c, True), cells.type_tag(c, df.schema[c].dataType)
            ).alias("tag"),
        )
        for c in cols
    ]
    return local.select("row_no", F.inline(F.array(*pairs))).where("tag IS NOT NULL")


def detect_header_row(df: DataFrame, order_by, rows: int = rules.HEADER_ROWS) -> int:
    """Earliest leading row with only text cells whose columns hold something else below.

    A row qualifies when, for at least one column, the most frequent tag beneath it
    differs from text. Row 0 when none qualifies.
    """
    tags = row_type_tags(df, order_by, rows)
    below = tags.alias("b")
    pairs = tags.alias("a").join(
        below, (F.col("a.column") == F.col("b.column")) & (F.col("b.row_no") > F.col("a.row_no"))
    )
    counted = pairs.groupBy(
        F.col("a.row_no").alias("row_no"), F.col("a.column").alias("column"), F.col("b.tag").alias("tag")
    ).agg(F.count("*").alias("n"))
    majority = counted.groupBy("row_no", "column").agg(
        F.max_by("tag", F.struct("n", "tag")).alias("below")
    )
    differs = majority.groupBy("row_no").agg(F.max(F.col("below") != "text").alias("differs"))
    text_only = tags.groupBy("row_no").agg(F.min(F.col("tag") == "text").alias("text_only"))
    row = (
        text_only.join(differs, "row_no").where("text_only AND differs").agg(F.min("row_no")).first()
    )
    return row[0] if row[0] is not None else 0


def clean_name(name: str) -> str:
    """Line breaks, tabs and slashes to ``_``; repeated ``_`` squeezed, ends stripped."""
    text = re.sub(r"[\n\r\t/\\]", "_", str(name).strip())
    return "_".join(p for p in text.split("_") if p)


def clean_column_names(df: DataFrame, order_by=()) -> DataFrame:
    names = [
        clean_name(c) or f"Unnamed_{i}" for i, c in enumerate(data_columns(df, order_by), start=1)
    ]
    return _rename_data(df, order_by, unique_names(names))


def snake_case_names(df: DataFrame, order_by=()) -> DataFrame:
    names = [c.strip().replace(" ", "_").lower() for c in data_columns(df, order_by)]
    return _rename_data(df, order_by, unique_names(names))


def apply_headers(df: DataFrame, names, order_by=()) -> DataFrame:
    """Rename all data columns; a list of another length changes nothing."""
    names = list(names)
    if len(names) != len(data_columns(df, order_by)):
        return df
    return _rename_data(df, order_by, names)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def name_generic_columns(df: DataFrame, order_by) -> DataFrame:
    """Name generic columns (``Column_k``, ``Unnamed``) after what they hold.

    A detected identifier pattern gives the name, else the dominant kind of the
    first values: number, date or text.
    """
    from gridwash.operators.validation import detected_patterns

    cols = data_columns(df, order_by)
    generic = [c for c in cols if re.match(r"^Column_\d+$", c) or "Unnamed" in c]
    if not generic:
        return df
    patterns = detected_patterns(df, order_by, generic)
    facts = {r["column"]: r for r in sample_facts(df, order_by, generic).collect()}

    def proposal(c):
        if c not in generic:
            return c
        if c in patterns:
            return patterns[c].lower()
        if c not in facts:
            return c
        counts = {k: facts[c][f"n_{k}"] for k in ("number", "date", "text")}
        return max(counts, key=counts.get)

    return _rename_data(df, order_by, unique_names([proposal(c) for c in cols]))


def preserve_shape(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``, or ``before`` when ``after`` has fewer rows or columns."""
    if len(after.columns) < len(before.columns):
        return before
    return after if after.count() >= before.count() else before


def observed_rows(df: DataFrame, name: str = "rows"):
    """The table and an Observation that counts its rows while another action runs."""
    watch = Observation()
    return df.observe(watch, F.count("*").alias(name)), watch


def header_pipeline(df: DataFrame, order_by) -> tuple[int, DataFrame, list[str]]:
    """Keep good headers; otherwise drop empties and promote the first row.

    Returns (header row or -1, table, log).
    """
    if headers_are_good(data_columns(df, order_by)):
        return -1, df, ["Good headers already detected, keeping original structure"]
    n_cols = len(data_columns(df, order_by))
    cols = data_columns(df, order_by)
    row = df.agg(
        F.count("*").alias("n"),
        F.count_if(~cells.all_of(_empty_cell(df, c, True) for c in cols)).alias("kept"),
        *[F.max(~_empty_cell(df, c, True)).alias(f"_f{i}") for i, c in enumerate(cols)],
    ).first()
    keep = [c for i, c in enumerate(cols) if row[f"_f{i}"]]
    keys = as_list(order_by)
    clean = drop_empty_rows(df, order_by).select(
        *[cells.column(c) for c in df.columns if c in keep or c in keys]
    )
    log = []
    gone_rows, gone_cols = row["n"] - row["kept"], n_cols - len(keep)
    if gone_rows or gone_cols:
        log.append(f"Removed {gone_rows} empty rows and {gone_cols} empty columns")
    if not row["kept"]:
        log.append("No data rows available after removing empty rows")
        return -1, clean, log
    log.append(f"Using first row as headers, {row['kept'] - 1} data rows remaining")
    return 0, promote_first_row(clean, order_by), log


def header_comparison(spark, current, proposed) -> DataFrame:
    """position, current, proposed."""
    one = spark.range(1).select(
        F.arrays_zip(
            F.array(*[F.lit(c) for c in current]).alias("current"),
            F.array(*[F.lit(c) for c in proposed]).alias("proposed"),
        ).alias("pairs")
    )
    return one.select(F.posexplode("pairs").alias("position", "pair")).select(
        "position", F.col("pair.current").alias("current"), F.col("pair.proposed").alias("proposed")
    )


def preview(df: DataFrame, order_by, n: int = 20) -> DataFrame:
    """The first n rows by order column."""
    return df.orderBy(*[cells.column(k) for k in as_list(order_by)]).limit(n)

