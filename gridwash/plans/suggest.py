"""Rule-based cleaning suggestions and the router from free text to an operation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridwash.functions import cells, rules
from gridwash.operators import structure
from gridwash.operators.profile import TableFacts, sample_facts, side_by_side
from gridwash.operators.sampling import data_columns
from gridwash.operators.validation import format_flags

_TABLE_STEP, _COLUMN_STEP = 1_000_000, 10

# --- fixed values: router words, first hit wins (any of, all of, operation) ----------
ROUTES = (
    (("duplicate",), (), "keep"),
    (("trim", "whitespace"), (), "trim"),
    (("missing", "null"), ("drop",), "keep"),
    (("missing", "null"), ("fill",), "fill"),
    (("missing", "null"), (), "mark_missing"),
    ((), ("convert", "numeric"), "to_numeric"),
    (("date", "datetime"), (), "to_datetime"),
    (("lowercase", "uppercase", "case"), ("lower",), "lower"),
    (("lowercase", "uppercase", "case"), ("upper",), "upper"),
    (("lowercase", "uppercase", "case"), (), "title"),
    ((), ("column", "drop"), "keep"),
    (("rename",), (), "snake_names"),
    (("outlier",), (), "mark_outliers"),
)


def route_action(text) -> Column:
    """Operation id of a free-text action."""
    lower = F.lower(cells.column(text))
    out = F.lit("keep")
    for words, needed, op in reversed(ROUTES):
        hit = cells.all_of(lower.contains(w) for w in needed)
        if words:
            hit = hit & cells.any_of(lower.contains(w) for w in words)
        out = F.when(hit, F.lit(op)).otherwise(out)
    return out


def route(text: str) -> str:
    """Operation id of one free-text action, on the driver."""
    lower = text.lower()
    for words, needed, op in ROUTES:
        if all(w in lower for w in needed) and (not words or any(w in lower for w in words)):
            return op
    return "keep"


def rule_suggestions(df: DataFrame, order_by, known: TableFacts | None = None) -> DataFrame:
    """Suggestion rows in fixed order: repeats, gaps, padding and case, dates as text,
    numbers as text, single values.

    rule_ord, category, description, action, priority, requires_code,
    affected_columns, impact, op. ``op`` is the operation the action routes to. ``known``
    saves measuring a table whose facts are there.
    """
    known = known or TableFacts(df, order_by)
    cols = known.columns
    place = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    facts = known.column_rows()
    percent = F.try_divide(F.col("missing") * 100.0, F.col("rows"))
    name = F.col("column")

    def row(step, sub, cond, category, priority, description, action, impact):
        return F.when(
            F.coalesce(cond, F.lit(False)),
            F.struct(
                (F.lit(step * _TABLE_STEP + sub) + place[name] * _COLUMN_STEP).alias("rule_ord"),
                F.lit(category).alias("category"),
                description.alias("description"),
                action.alias("action"),
                F.lit(priority).alias("priority"),
                impact.alias("impact"),
            ),
        )

    def texts(kind, *values):
        """Description, action and impact of a rule, filled with their values."""
        filled = [*values, *[()] * (3 - len(values))]
        return [F.format_string(t, *v) for t, v in zip(rules.SUGGESTION_TEXTS[kind], filled)]

    found = F.array_compact(
        F.array(
            row(
                1, 0, percent > 70, "missing", "medium",
                *texts("missing", (name, percent), (name,), (percent,)),
            ),
            row(2, 0, F.col("padded_20"), "text", "high", *texts("padding", (name,))),
            row(
                2, 1, F.col("distinct_lower") < F.col("distinct_raw"), "text", "medium",
                *texts("case", (name,), (), ("distinct_raw", "distinct_lower")),
            ),
            row(3, 0, F.col("all_dates"), "datetime", "high", *texts("dates", (name,))),
            row(
                4, 0, F.col("all_numbers") & ~F.col("all_dates"), "numerical", "high",
                *texts("numbers", (name,)),
            ),
            row(5, 0, F.col("single"), "structural", "low", *texts("single", (name,))),
        )
    )
    per_col = facts.select("column", F.inline(found)).select(
        "rule_ord", "category", "description", "action", "priority",
        F.lit(True).alias("requires_code"), F.array("column").alias("affected_columns"), "impact",
    )
    n = F.col("duplicate_rows")
    description, action, impact = texts("repeats", (n,), (), (n,))
    repeats = (
        known.repeat_row()
        .where("duplicate_rows > 0")
        .select(
            F.lit(0).alias("rule_ord"),
            F.lit("duplicates").alias("category"),
            description.alias("description"),
            action.alias("action"),
            F.lit("high").alias("priority"),
            F.lit(True).alias("requires_code"),
            F.array(*[F.lit(c) for c in cols]).alias("affected_columns"),
            impact.alias("impact"),
        )
    )
    op_of = {
        "duplicates": "keep", "missing": "keep", "datetime": "to_datetime",
        "numerical": "to_numeric", "structural": "keep",
    }
    op = reduce(
        lambda acc, kv: F.when(F.col("category") == kv[0], F.lit(kv[1])).otherwise(acc),
        op_of.items(),
        F.when(F.col("action").startswith("Trim"), "trim").otherwise("title"),
    )
    return repeats.unionByName(per_col).withColumn("op", op)


def top_suggestions(suggestions: DataFrame, n: int = 5) -> DataFrame:
    """The first n by rule order, of those the ones that need code."""
    return suggestions.orderBy("rule_ord").limit(n).where("requires_code")


def quick_suggestions(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """Up to n short suggestion lines."""
    return top_suggestions(rule_suggestions(df, order_by), n).select(
        "rule_ord", F.concat_ws(": ", "action", "description").alias("suggestion")
    )


def cleaning_needed(df: DataFrame, order_by) -> DataFrame:
    """needed, padded, dates_as_text, numbers_as_text, format_flags, good_headers.

    Cleaning is needed when any sampled column is padded or mistyped, a format flag
    is raised, or the headers are poor.
    """
    facts = sample_facts(df, order_by).agg(
        F.count_if(F.col("padded_100")).alias("padded"),
        F.count_if(F.col("all_dates")).alias("dates_as_text"),
        F.count_if(F.col("all_numbers") & ~F.col("all_dates")).alias("numbers_as_text"),
    )
    flags = format_flags(df, order_by).agg(F.count("*").alias("format_flags"))
    good = structure.headers_are_good(data_columns(df, order_by))
    counts = side_by_side([facts, flags]).withColumn("good_headers", F.lit(good))
    hits = F.col("padded") + F.col("dates_as_text") + F.col("numbers_as_text") + F.col("format_flags")
    return counts.withColumn("needed", (hits > 0) | ~F.col("good_headers"))
