"""Apply chosen operations as one lazy plan, and the bounded clean-and-rescore loop.

Built-in steps are projections over all text columns: they cannot lose a row or a
column. Steps from outside pass the shape guard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from gridwash.functions import cells, rules
from gridwash.operators import convert, score, structure, validation
from gridwash.operators.profile import TableFacts
from gridwash.operators.sampling import as_list, data_columns, text_columns
from gridwash.plans.suggest import route, rule_suggestions, top_suggestions
from gridwash.session import drop_stored, stored

# Operations that report and leave the table as it is.
REPORT_ONLY = ("keep", "mark_missing", "mark_outliers")

STEPS: dict[str, Callable[[DataFrame, object], DataFrame]] = {
    "trim": lambda df, o: convert.trim_all(df, o),
    "null_tokens": lambda df, o: convert.null_all_tokens(df, o),
    "fill": lambda df, o: convert.fill_missing(df, "", o),
    "to_numeric": lambda df, o: convert.to_numeric_safe(df, o),
    "to_datetime": lambda df, o: convert.to_datetime_safe(df, o),
    "lower": lambda df, o: convert.case_all(df, "lower", o),
    "upper": lambda df, o: convert.case_all(df, "upper", o),
    "title": lambda df, o: convert.case_all(df, "title", o),
    "snake_names": lambda df, o: structure.snake_case_names(df, o),
    "dates": lambda df, o: convert.standardize_dates(df, o),
    "formats": lambda df, o: convert.standardize_by_format(df, o),
    "repair": lambda df, o: validation.auto_standardize(df, o),
}


def _apply_one(df: DataFrame, order_by, step) -> DataFrame:
    if callable(step):
        return structure.preserve_shape(df, step(df))
    if isinstance(step, dict):
        return df.withColumns({c: F.expr(e) for c, e in step.items()})
    op = step if step in STEPS or step in REPORT_ONLY else route(step)
    return df if op in REPORT_ONLY else STEPS[op](df, order_by)


def apply_plan(df: DataFrame, order_by, steps) -> DataFrame:
    """Run steps in order. A step is an operation id, a free-text action, a dict of
    column -> SQL expression, or a function of the table (shape-guarded)."""
    for step in steps:
        df = _apply_one(df, order_by, step)
    return df


# Steps that change a cell by a function of that cell alone.
ROW_LOCAL = {
    "trim": cells.trim_text,
    "null_tokens": cells.null_tokens,
    "fill": lambda c: F.coalesce(c, F.lit("")),
    "lower": F.lower,
    "upper": F.upper,
    "title": F.initcap,
}


def apply_observed(df: DataFrame, order_by, steps) -> tuple[DataFrame, list]:
    """Row-local steps with an Observation each that counts changed cells per text
    column while the result is computed: no second scan."""
    cols = text_columns(df, order_by)
    watches = []
    for step in steps:
        new = {c: ROW_LOCAL[step](cells.column(c)) for c in cols}
        watch = Observation()
        changed = [F.count_if(~cells.column(c).eqNullSafe(e)).alias(c) for c, e in new.items()]
        df = df.observe(watch, *changed).withColumns(new)
        watches.append((step, watch))
    return df, watches


def change_log(spark, watches) -> DataFrame:
    """step_no, step, column, changed: one row per column a step changed.

    Call it after an action ran on the table of :func:`apply_observed`.
    """
    rows = [
        (i, step, column, int(n))
        for i, (step, watch) in enumerate(watches)
        for column, n in watch.get.items()
        if n
    ]
    return spark.createDataFrame(rows, "step_no int, step string, column string, changed bigint")


def clean_until(
    df: DataFrame, order_by, threshold: int = 50, max_iterations: int = 2, per_round: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Suggest, apply, score; stop at the threshold, without suggestions, or at the limit.

    Returns the table and one history row per round. Each round ends in a written table,
    so the plan does not grow and lost executors do not replay rounds; a round's table is
    deleted when the next one is written. A table is measured once: the facts behind its
    score are those behind the next round's suggestions.
    """
    history = []
    facts = TableFacts(df, order_by)
    for i in range(1, max_iterations + 1):
        chosen = top_suggestions(rule_suggestions(df, order_by, facts), per_round).collect()
        if not chosen:
            break
        # Suggestions come in rule order and their operations work on all columns at once
        # and change nothing the second time, so each is applied once.
        steps = list(dict.fromkeys(r["op"] for r in chosen))
        before, df = df, stored(apply_plan(df, order_by, steps), "round")
        if i > 1:
            drop_stored(before)
        facts = TableFacts(df, order_by)
        report = score.dimension_scores(score.measure(df, order_by, with_memory=False, known=facts))
        row = report.select("n_rows", "n_cols", score.total_score().alias("score")).first()
        history.append((i, row["score"], len(chosen), row["n_rows"], row["n_cols"]))
        if row["score"] >= threshold:
            break
    log = df.sparkSession.createDataFrame(
        history, "iteration int, quality_score int, changes_applied int, rows bigint, columns bigint"
    )
    return df, log


def basic_clean(
    df: DataFrame, order_by, formats: bool = False, name_generic: bool = False,
    on_unparsed: str = "keep",
) -> tuple[DataFrame, list[str]]:
    """The file-clean sequence on a raw, headerless table.

    Drop null rows and columns, find the header, clean names, trim, standardise
    formats and dates, null the missing-value tokens. Returns table and change log.
    """
    cols = data_columns(df, order_by)
    keys = as_list(order_by)
    types = {f.name: f.dataType for f in df.schema}
    filled = {c: ~cells.is_missing(c, types[c]) for c in cols}
    row = df.agg(
        F.count("*").alias("n"),
        F.count_if(cells.any_of(filled.values())).alias("kept"),
        *[F.max(filled[c]).alias(f"_f{i}") for i, c in enumerate(cols)],
    ).first()
    keep = [c for i, c in enumerate(cols) if row[f"_f{i}"]]
    said = rules.CLEAN_LOG
    log = [said["loaded"].format(rows=row["n"], columns=len(cols))]
    if row["n"] > row["kept"]:
        log.append(said["rows"].format(n=row["n"] - row["kept"]))
    if len(cols) > len(keep):
        log.append(said["columns"].format(n=len(cols) - len(keep)))
    out = structure.drop_null_rows(df, order_by).select(
        *[cells.column(c) for c in df.columns if c in keep or c in keys]
    )
    if row["kept"]:
        k = structure.detect_header_row(out, order_by)
        out = structure.promote_header_row(out, order_by, k)
        log.append(said["header"].format(k=k + 1))
    else:
        out = structure.generate_names(out, order_by)
        log.append(said["no_header"])
    out = structure.clean_column_names(out, order_by)
    log.append(said["names"].format(n=len(data_columns(out, order_by))))
    if name_generic:
        out = structure.name_generic_columns(out, order_by)
    out = convert.trim_all(out, order_by)
    log.append(said["trimmed"])
    if formats:
        kinds = convert.column_kinds(out, order_by)
        out = out.withColumns({c: convert.rewrite_kind(c, k) for c, k in kinds.items()})
        log += [said["format"].format(column=c, kind=k) for c, k in kinds.items()]
    dates = convert.date_columns(out, order_by)
    out = convert.standardize_dates(out, order_by, dates, on_unparsed=on_unparsed)
    log += [said["dates"].format(column=c) for c in dates]
    out = convert.null_all_tokens(out, order_by)
    log.append(said["nulls"])
    n_cols = len(data_columns(out, order_by))
    if n_cols > len(cols):
        log.append(said["changed"].format(before=len(cols), after=n_cols))
    return out, log


def basic_change_log(spark, log: list[str]) -> DataFrame:
    """step_no, change."""
    return spark.createDataFrame(list(enumerate(log)), "step_no int, change string")
