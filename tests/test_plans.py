"""Suggestions, plans, the loop and the file-clean sequence."""

from pyspark.sql import functions as F

from gridwash.plans import apply, suggest


def test_route_driver_and_column_agree(spark):
    texts = [
        "Drop duplicate rows keeping first occurrence", "Trim whitespace", "drop missing", "fill null", "missing?",
        "Convert to numeric type", "Convert to datetime format", "lowercase all", "UPPERCASE", "Standardize text case",
        "drop column x", "rename columns", "handle outliers", "validate", "nothing to do",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["op"] for r in df.select("t", suggest.route_action("t").alias("op")).collect()}
    assert got == {t: suggest.route(t) for t in texts}
    # Words match inside words.
    assert got["validate"] == "to_datetime"


def test_guard_rejects_lost_rows_and_columns(spark):
    df = spark.createDataFrame([(1, " a"), (2, "b")], "o int, v string")
    out = apply.apply_plan(df, "o", [lambda d: d.where("o = 1"), lambda d: d.drop("v"), "trim"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b")]


def test_loop_stops_at_threshold_and_keeps_shape(data):
    df = data.fixture("dirty_orders")
    out, log = apply.clean_until(df, "row_id")
    rows = log.collect()
    assert len(rows) == 1 and rows[0]["quality_score"] >= 50
    assert out.count() == df.count() and out.columns == df.columns
    assert dict(out.dtypes)["order_date"] in ("string", "timestamp_ntz")


def test_loop_without_suggestions(spark):
    df = spark.createDataFrame([(i, f"name{i}x", float(i)) for i in range(30)], "o int, label string, qty double")
    out, log = apply.clean_until(df, "o")
    assert log.count() == 0 and out.count() == 30


def test_basic_clean(spark):
    rows = [(0, None, None, None), (1, "Name", "When", None), (2, " Ann ", "01-02-2024", None), (3, "N/A", "2024/02/03", None),
            (4, "Bob", "3 Mar", None), (5, "Cy", "05/06/2024", None)]
    df = spark.createDataFrame(rows, "o int, c0 string, c1 string, c2 string")
    out, log = apply.basic_clean(df, "o")
    assert out.columns == ["o", "Name", "When"]
    assert [tuple(r)[1:] for r in out.orderBy("o").collect()] == [
        ("Ann", "2024/02/01"), (None, "2024/02/03"), ("Bob", "3 Mar"), ("Cy", "2024/06/05")]
    assert "Removed 1 completely empty rows" in log and "Removed 1 completely empty columns" in log


def test_basic_clean_of_nothing(spark):
    df = spark.createDataFrame([(0, None)], "o int, c0 string")
    out, log = apply.basic_clean(df, "o")
    assert out.count() == 0 and out.columns == ["o"]


def test_change_log_counts(spark):
    df = spark.createDataFrame([(1, " a"), (2, "N/A"), (3, None)], "o int, v string")
    out, watches = apply.apply_observed(df, "o", ["trim", "null_tokens"])
    out.write.format("noop").mode("overwrite").save()
    assert [tuple(r) for r in apply.change_log(spark, watches).collect()] == [(0, "trim", "v", 1), (1, "null_tokens", "v", 1)]


def test_cleaning_not_needed(spark):
    df = spark.createDataFrame([(i, f"name {i}x", float(i)) for i in range(9)], "o int, label string, qty double")
    assert suggest.cleaning_needed(df, "o").select(F.col("needed")).first()[0] is False
