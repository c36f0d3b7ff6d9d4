"""Consistency operations: categories, booleans, types, identifiers, spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridwash.functions import cells, formats


def normalize_categories(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Map variants to one category by a (variant, category) table.

    Variants match without regard to case and padding; unknown values stay. The
    optimizer broadcasts the mapping when its measured size allows, else AQE splits
    hot values of the big side.
    """
    key = lambda c: F.lower(cells.trim_text(c))
    table = mapping.groupBy(key("variant").alias("_key")).agg(F.min("category").alias("_category"))
    joined = df.withColumn("_key", key(column)).join(table, "_key", "left")
    out = F.coalesce("_category", cells.column(column))
    return joined.select(*[out.alias(c) if c == column else cells.column(c) for c in df.columns])


def fix_phone(c) -> Column:
    return formats.repair(c, "phone")


def is_email(c) -> Column:
    return formats.is_valid(c, "email")


# --- fixed values: spellings of true and false --------------------------------------
TRUE_WORDS = ("yes", "y", "1", "true", "t")
FALSE_WORDS = ("no", "n", "0", "false", "f")


def normalize_boolean(c) -> Column:
    """Boolean of the usual spellings; anything else is null."""
    text = F.lower(cells.trim_text(cells.column(c).cast("string")))
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def ensure_types(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Cast columns to declared types; what does not fit becomes null."""
    return df.withColumns({c: cells.column(c).try_cast(t) for c, t in schema.items()})


def type_rejects(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """column, type, rejects: non-null values that do not fit the declared type."""
    from gridwash.operators.profile import per_column

    bad = {c: cells.column(c).isNotNull() & cells.column(c).try_cast(t).isNull() for c, t in schema.items()}
    return per_column(
        df,
        schema,
        {"type": lambda c: F.first(F.lit(schema[c])), "rejects": lambda c: F.count_if(bad[c])},
    )


def harmonize_id(c, width: int = 10) -> Column:
    """Upper-case letters and digits only, left-padded with zeros; never cut."""
    text = F.upper(F.regexp_replace(cells.column(c).cast("string"), r"[^A-Za-z0-9]", ""))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def _piece(i: int, length: Column, pieces: int) -> tuple[Column, Column]:
    """Start (from 0) and size of the ``i``-th of even pieces of a text of some length."""
    start, end = (F.floor(length * j / pieces).cast("int") for j in (i, i + 1))
    return start, end - start


def _pieces(value: Column, edits: int) -> Column:
    """Hashes of a value's even pieces, with its length and their numbers."""
    length = F.char_length(value)
    places = (_piece(i, length, edits + 1) for i in range(edits + 1))
    return F.array(
        *[F.xxhash64(length, F.lit(i), F.substr(value, start + 1, size)) for i, (start, size) in enumerate(places)]
    )


def _windows(value: Column, length: Column, edits: int) -> Column:
    """Hashes of what may stand in a value where a text of ``length`` has its pieces."""
    found = []
    for i in range(edits + 1):
        start, size = _piece(i, length, edits + 1)
        for shift in range(-edits, edits + 1):
            inside = (start + shift >= 0) & (start + shift + size <= F.char_length(value))
            found.append(F.when(inside, F.xxhash64(length, F.lit(i), F.substr(value, start + (shift + 1), size))))
    return F.array_distinct(F.array_compact(F.array(*found)))


def spelling_corrections(df: DataFrame, column: str, frequent: int = 10, edits: int = 1) -> DataFrame:
    """value, correction: rare values at most ``edits`` edits away from a frequent value.

    Works on distinct values. A frequent value is cut into edits + 1 even pieces; of a
    value within the distance at least one piece is untouched and stands at most
    ``edits`` places off. So candidates come from an equi-join on the hashes of pieces
    (one row per piece of a frequent value; (2 * edits + 1)^2 places per piece of a rare
    one, whatever its length) and are then verified. The nearest candidate wins, then the
    most frequent, then the first by name. Null is no value; the empty text is one.
    """
    counted = (
        df.select(cells.column(column).alias("value"))
        .where("value IS NOT NULL")
        .groupBy("value")
        .agg(F.count("*").alias("n"))
    )
    good = counted.where(F.col("n") >= frequent).select(
        F.col("value").alias("correction"), F.col("n").alias("votes"), F.explode(_pieces(F.col("value"), edits)).alias("piece")
    )
    near = F.explode(F.sequence(F.greatest(F.char_length("value") - edits, F.lit(0)), F.char_length("value") + edits))
    rare = counted.where(F.col("n") < frequent).select("value", near.alias("length"))
    rare = rare.select("value", F.explode(_windows(F.col("value"), F.col("length"), edits)).alias("piece"))
    pairs = rare.join(good, "piece").groupBy("value", "correction").agg(F.first("votes").alias("votes"))
    distance = F.levenshtein("value", "correction", edits)
    # The smallest (distance, -votes, name) is the nearest, most frequent, first candidate.
    best = pairs.withColumn("distance", distance).where("distance >= 0").groupBy("value").agg(
        F.min(F.struct("distance", (-F.col("votes")).alias("v"), "correction")).alias("best")
    )
    return best.select("value", F.col("best.correction").alias("correction"))


def fix_spelling(df: DataFrame, column: str, frequent: int = 10, edits: int = 1) -> DataFrame:
    """Replace rare misspellings by the nearest frequent value within ``edits`` edits."""
    fixes = spelling_corrections(df, column, frequent, edits).withColumnRenamed("value", "_value")
    joined = df.join(fixes, cells.column(column) == F.col("_value"), "left")
    out = F.coalesce("correction", cells.column(column))
    return joined.select(*[out.alias(c) if c == column else cells.column(c) for c in df.columns])
