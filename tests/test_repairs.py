"""Inputs that once stopped a job or lost rows."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwash.operators.catalogue import dates, gaps
from gridwash.operators.quantiles import exact_quantiles
from gridwash.sources import store

DAY = datetime.date


def test_gaps_of_any_width_are_one_row(spark):
    df = spark.createDataFrame(
        [("a", DAY(1, 1, 1), 1), ("a", DAY(9999, 12, 31), 2), ("b", DAY(2024, 1, 1), 3), ("b", DAY(2024, 1, 2), 3), (None, DAY(2024, 1, 1), 4),
         (None, DAY(2024, 1, 4), 5), (None, DAY(2024, 1, 4), 5), ("c", None, 6)],
        "k string, day date, v int",
    )
    got = {r["k"]: (r["missing_from"], r["missing_to"], r["days"]) for r in dates.missing_date_ranges(df, "k", "day").collect()}
    assert got == {"a": (DAY(1, 1, 2), DAY(9999, 12, 30), 3652057), None: (DAY(2024, 1, 2), DAY(2024, 1, 3), 2)}
    with pytest.raises(Exception, match="3652057 missing days for one key"):
        dates.fill_missing_dates(df, "k", "day").collect()
    kept = dates.fill_missing_dates(df.where("k IS NULL OR k <> 'a'"), "k", "day")
    assert kept.columns == ["k", "day", "v"]
    assert sorted(map(str, kept.collect())) == sorted(
        str(r) for r in [*df.where("k IS NULL OR k <> 'a'").collect(), *kept.where("k IS NULL AND v IS NULL").collect()]
    )
    assert kept.where("v IS NULL").count() == 2


def test_text_dates_that_cannot_be_read_stay(spark):
    rows = [("a", "2024-01-01", 1), ("a", "soon", 2), ("a", "04/01/2024", 3), ("a", None, 4), ("b", "never", 5)]
    df = spark.createDataFrame(rows, "k string, day string, v int")
    got = dates.fill_missing_dates(df, "k", "day").collect()
    assert {(r.k, r.day, r.v) for r in got if r.v in (2, 4, 5)} == {("a", "soon", 2), ("a", None, 4), ("b", "never", 5)}
    days = sorted(r.day for r in got if r.k == "a" and r.day and r.day != "soon")
    assert len(days) == len(set(days)) and days[0] == "2024-01-01" and {r.v for r in got} == {1, 2, 3, 4, 5, None}


def test_regression_treats_nan_as_missing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, float(i), 2.0 * i + 1, i % 3) for i in range(20)]
    rows += [(20, 5.0, nan, 0), (21, 6.0, None, 0), (22, nan, nan, 0), (23, None, 4.0, 0), (24, 3.0, inf, 1)]
    df = spark.createDataFrame(rows, "id int, x double, y double, `z z` int")
    got = {r.id: r.y for r in gaps.impute_regression(df, "y", ["x", "z z"]).collect()}
    assert abs(got[20] - 11) < 1e-6 and abs(got[21] - 13) < 1e-6
    assert got[22] is None and got[23] == 4.0 and got[24] == inf and all(got[i] == 2 * i + 1 for i in range(20))
    none = gaps.impute_regression(df.where("id >= 20 AND id < 23"), "y", "x").collect()
    assert [r.y for r in none] == [None] * 3


def test_modes_of_columns_of_any_type(spark):
    rows = [(1, "b", 1.0, None), (1, "a", float("nan"), None), (2, "a", 1.0, None), (2, "b", -0.5, None), (None, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "a int, `b b` string, c double, d date")
    assert gaps.column_modes(df, df.columns) == {"a": 1, "b b": "a", "c": 1.0, "d": None}


def test_stage_of_tables_of_different_types(spark, tmp_path):
    root = str(tmp_path)
    store.write_stage(spark.createDataFrame([(1, "x")], "a int, b string"), root, "Book", "S", "uploads", "1")
    store.write_stage(spark.createDataFrame([("n/a", 2.5)], "A string, c double"), root, "Book", "S", "uploads", "a/b c+d")
    store.write_stage(spark.createDataFrame([(7, "y")], "a int, b string"), root, "Book", "S", "uploads", "3")
    got = store.read_stage(spark, root, "Book", "S", "uploads")
    assert got.columns == ["a", "b", "c"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("1", "x", None), ("n/a", None, 2.5), ("7", "y", None)]))
    with pytest.raises(FileNotFoundError):
        store.read_stage(spark, root, "Book", "S", "cleaned")


@pytest.mark.parametrize("digit, limit", [(4, 1 << 22), (22, 60), (22, 1 << 22), (64, 1)])
def test_quantiles_by_digits_equal_numpy(spark, digit, limit):
    rnd = random.Random(4)
    wide = [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(400)]
    near = [1 + k * 2.0**-52 for k in range(400)]
    special = [rnd.choice([0.0, -0.0, float("inf"), -5e-324, 5e-324, 1.0]) for _ in range(400)]
    whole = [rnd.choice([None, 2**53 - 1, -(2**40), 7]) for _ in range(400)]
    df = spark.createDataFrame(list(zip(wide, near, special, whole)), "a double, b double, c double, d long").repartition(6)
    probs = (0.0, 0.003, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = exact_quantiles(df, df.columns, probs, limit=limit, digit=digit)
    for c, values in zip(df.columns, (wide, near, special, whole)):
        values = np.sort(np.array([v for v in values if v is not None], float))
        for p, q in zip(probs, got[c]):
            lo, hi = values[int(np.floor(p * (len(values) - 1)))], values[int(np.ceil(p * (len(values) - 1)))]
            assert min(lo, hi) <= q <= max(lo, hi) and (lo != hi or q == lo)
        assert got[c][0] == values[0] and got[c][-1] == values[-1]


def test_quantiles_need_a_bounded_number_of_passes(spark):
    df = spark.range(20000).select(F.rand(3).alias("a"), (F.col("id") % 50).cast("double").alias("b"), F.randn(5).alias("c")).cache()
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for name, columns in (("whole", ["b"]), ("all", ["a", "b", "c"])):
        spark.sparkContext.setJobGroup(f"digits-{name}", "")
        exact_quantiles(df, columns)
        jobs[name] = len(tracker.getJobIdsForGroup(f"digits-{name}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # One pass settles small whole numbers; three passes settle any column.
    assert jobs["all"] <= 3 * jobs["whole"]
