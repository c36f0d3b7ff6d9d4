"""Headers, empties, conversions."""

import pytest
from pyspark.sql import functions as F

from gridwash.operators import convert, structure, validation


@pytest.mark.parametrize(
    "names, good",
    [
        (["Name", "Amount", "City"], True),
        (["Unnamed: 0", "Unnamed: 1", "City"], False),
        (["0", "1", "2"], False),
        (["Name", "12.5", "2024-01-01"], False),
        (["Name", "Amount", "City", "12.5"], True),
        (["Column_1", "b"], False),
        ([], False),
    ],
)
def test_headers_are_good(names, good):
    assert structure.headers_are_good(names) is good


def test_unique_names_never_collide():
    assert structure.unique_names(["A", "A", "A_1", "A"]) == ["A", "A_1", "A_1_1", "A_2"]


def test_header_names():
    assert structure.header_names([" x ", None, "", "x", "y" * 101], 100) == ["x", "Column_2", "Column_3", "x_1", "Column_5"]


def test_clean_name():
    assert structure.clean_name(" a/b\\c\n__d_ ") == "a_b_c_d"


def test_promote_with_compound_order(spark):
    df = spark.createDataFrame(
        [(1, 2, "c"), (1, 1, "h"), (0, 9, "junk"), (2, 0, "d")], "a int, b int, v string"
    )
    out = structure.promote_header_row(df, ["a", "b"], 1)
    assert out.columns == ["a", "b", "h"]
    assert sorted(r["h"] for r in out.collect()) == ["c", "d"]


def test_header_pipeline_logs(spark, data):
    df = data.fixture("raw_sheet").toDF("row_id", *"01234")
    index, out, log = structure.header_pipeline(df, "row_id")
    assert index == 0 and out.columns == ["row_id", "Name", "Key", "Key_1", "Column_4"]
    assert log[0] == "Removed 1 empty rows and 1 empty columns"
    kept, same, _ = structure.header_pipeline(out, "row_id")
    assert kept == -1 and same.columns == out.columns


def test_detect_header_default_is_first(spark):
    df = spark.createDataFrame([(i, "a", "b") for i in range(5)], "o int, x string, y string")
    assert structure.detect_header_row(df, "o") == 0


def test_conversions_keep_what_does_not_fit(spark):
    df = spark.createDataFrame(
        [(0, "1", "01/02/2024"), (1, "x", "soon"), (2, None, "2024-03-04")], "o int, n string, d string"
    )
    assert dict(convert.to_numeric_safe(df, "o").dtypes)["n"] == "string"
    dated = convert.to_datetime_safe(df, "o")
    assert dict(dated.dtypes) == {"o": "int", "n": "string", "d": "timestamp_ntz"}
    kept = convert.standardize_dates(df, "o").orderBy("o").collect()
    assert [r["d"] for r in kept] == ["2024/02/01", "soon", "2024/03/04"]
    nulled = convert.standardize_dates(df, "o", on_unparsed="null").orderBy("o").collect()
    assert [r["d"] for r in nulled] == ["2024/02/01", None, "2024/03/04"]


def test_date_pass_is_idempotent(data):
    df = data.fixture("dirty_orders").select("row_id", "order_date")
    once = convert.standardize_dates(df, "row_id")
    twice = convert.standardize_dates(once, "row_id")
    assert once.exceptAll(twice).count() == 0 and df.count() == once.count()


def test_repair_properties(data):
    df = data.fixture("contacts")
    before = validation.violation_summary(df, "row_id").agg(F.sum("violations")).first()[0]
    fixed = validation.auto_standardize(df, "row_id")
    after = validation.violation_summary(fixed, "row_id").agg(F.sum("violations")).first()[0]
    assert after < before and fixed.count() == df.count() and fixed.columns == df.columns
    again = validation.auto_standardize(fixed, "row_id")
    assert fixed.exceptAll(again).count() == 0


def test_observed_counts_equal_counted(data):
    df = data.fixture("contacts")
    fixed, watch = validation.observed_standardize(df, "row_id")
    fixed.write.format("noop").mode("overwrite").save()
    counted = validation.standardize_counts(df, "row_id").collect()
    assert counted
    for r in counted:
        assert watch.get[f"standardized:{r['column']}"] == r["standardized"]
        assert watch.get[f"invalid:{r['column']}"] == r["invalid"]


def test_unknown_and_all_null_patterns(spark):
    df = spark.createDataFrame([(1, None)], "o int, v string")
    assert validation.validate_column(df, "v", "NOPE", "o").first()["error"] == "Unknown format: NOPE"
    empty = validation.validate_column(df, "v", "EMAIL", "o").first()
    assert empty["valid"] and empty["message"] == "No values to validate (all null)"


def test_column_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1, " a ", None), (2, "b", " ")], "`row id` int, `a.b` string, `c d` string")
    out = convert.trim_all(structure.drop_empty_columns(df, "row id"), "row id").orderBy("`row id`")
    assert [tuple(r) for r in out.collect()] == [(1, "a"), (2, "b")]
