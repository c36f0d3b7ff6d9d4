"""Rows, values and records that must not be lost or invented; NaN is missing."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from gridwash.functions import cells
from gridwash.operators import ordered, profile
from gridwash.operators.catalogue import checks, dates, duplicates, gaps
from gridwash.sources import tables

NAN = float("nan")


@pytest.fixture(scope="module")
def holes(spark):
    data = [(1, 1.0, "a"), (2, NAN, "a"), (3, None, "a"), (4, 3.0, "b"), (5, NAN, None), (6, None, None)]
    return spark.createDataFrame(data, "id int, v double, t string")


def test_nan_is_missing_in_profiles(holes):
    row = profile.numeric_stats(holes, "id").first()
    assert (row["min"], row["max"], row["mean"]) == (1.0, 3.0, 2.0)
    row = profile.describe(holes, "id").first()
    assert (row["count"], row["max"], row["mean"], row["q50"]) == (2, 3.0, 2.0, 2.0)
    row = profile.column_profile(holes, "id").where("`column` = 'v'").first()
    assert (row["missing_count"], row["max"], row["unique_count"]) == (4, 3.0, 2)


def test_nan_equals_null_in_repeats(holes):
    for digest in (False, True):
        assert profile.duplicate_rows(holes, "id", digest).first()[0] == 2
    assert profile.any_defects(holes, "id").first()["any_duplicates"]
    kept = duplicates.drop_exact_duplicates(holes, "id").orderBy("id").collect()
    assert [r["id"] for r in kept] == [1, 2, 4, 5]


def test_nan_is_filled_and_never_an_anomaly(holes):
    for statistic, value in (("mean", 2.0), ("median", 2.0), ("mode", 1.0)):
        got = [r["v"] for r in gaps.fill_with_statistic(holes, statistic, ["v"]).orderBy("id").collect()]
        assert got == [1.0, value, value, 3.0, value, value]
    many = holes.union(holes.sparkSession.range(40).select(F.col("id").cast("int"), F.lit(1.0), F.lit("a")))
    many = many.union(holes.sparkSession.createDataFrame([(99, 50.0, "a")], holes.schema))
    for keys in ((), "t"):
        out = checks.anomalies(many, "v", keys)
        assert [r["id"] for r in out.where("anomaly").collect()] == [99]
        assert out.where("isnan(z_score)").count() == 0
    assert checks.iqr_anomalies(holes, "v").count() == 0


def test_nan_is_null_in_records(holes):
    got = [r["record"] for r in tables.to_records_json(holes.where("id = 2"), "id").collect()]
    assert got == ['{"v":null,"t":"a"}']


def test_tiny_doubles_stay_apart(spark):
    df = spark.createDataFrame([(1e-12,), (2e-12,), (3e-12,), (0.5,)], "v double")
    assert profile.unique_count(df).first()["unique_count"] == 4
    assert df.select(cells.safe_str("v", df.schema["v"].dataType)).collect()[3][0] == "0.5"


def test_padded_dates_are_dates(spark):
    df = spark.createDataFrame([(" " * 80 + "2024-03-01" + " " * 80,)], "d string")
    assert df.select(cells.parse_datetime("d")).first()[0] == datetime.datetime(2024, 3, 1)


def test_title_parity(spark):
    texts = ["o'neil mc-x", "ÉTÉ 3rd", "", None, "  a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(cells.case_text("t", "title_parity"))
    assert [r[0] for r in df.collect()] == ["O'Neil Mc-X", "Été 3Rd", "", None, "  A B"]


def test_calendars_lose_no_rows(spark):
    d = datetime.date
    data = [("a", d(2024, 1, 1), 1), ("a", d(2024, 1, 3), 2), ("a", None, 3), ("b", None, 4), (None, d(2024, 1, 5), 5)]
    out = dates.fill_missing_dates(spark.createDataFrame(data, "k string, day date, v int"), "k", "day")
    assert out.columns == ["k", "day", "v"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [*data, ("a", d(2024, 1, 2), None)]))


def test_reference_records_stay_whole(spark):
    reference = spark.createDataFrame([(1, "a", "z"), (1, "b", "y")], "k int, x string, y string")
    out = checks.cross_reference(spark.createDataFrame([(1,), (2,)], "id int"), "id", reference, "k", ["x", "y"])
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == ["(1, 'a', 'z', True)", "(2, None, None, False)"]


def test_texts_without_words_are_no_copies(spark):
    df = spark.createDataFrame([(1, "!!!"), (2, "---"), (3, ""), (4, "a b"), (5, "B, a!")], "id int, t string")
    assert sorted(r["id"] for r in duplicates.near_duplicates(df, "id", "t").collect()) == [4, 5]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_running_totals_do_not_depend_on_chunks(spark, kind):
    rows = [(k, i // (3 if k == 2 else 1), i, None if i % 4 == 0 or i < 6 else i) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, o int, o2 int, v int").repartition(4)
    df = df.withColumn("o", F.lpad(F.col("o").cast("string"), 3, "0")) if kind == "string" else df
    whole = ordered.running_total(df, "k", ["o", "o2"], "v", "total", "delta").orderBy("k", "o", "o2").collect()
    for limit in (1, 7, 20):
        cut = ordered.running_total(df, "k", ["o", "o2"], "v", "total", "delta", limit).orderBy("k", "o", "o2").collect()
        assert cut == whole
        filled = ordered.fill_along(df, "k", ["o", "o2"], "v", group_limit=limit).orderBy("k", "o", "o2").collect()
        assert filled == ordered.fill_along(df, "k", ["o", "o2"], "v").orderBy("k", "o", "o2").collect()
    assert whole[0]["total"] is None and not any(isinstance(r["total"], float) and math.isnan(r["total"]) for r in whole)
