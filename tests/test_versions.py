"""Differences of tables, fleets, as-of joins and stored sketches against plain versions."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridwash import session
from gridwash.operators import compare, fleet, ordered, profile, usage
from gridwash.plans import apply
from gridwash.sources import sketches

SCHEMA = "o int, a string, b double, change string, copies int"


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(3)


def test_row_difference_equals_multisets(spark):
    nan, rnd = float("nan"), random.Random(2)
    pool = [("x", 1.0, "c", 1), ("x", nan, "c", 1), ("x", None, "c", 1), (None, 0.0, None, 2), (None, -0.0, None, 2), ("é", 2.5, "", 3)]
    norm = lambda r: tuple(None if x != x else x + 0.0 if isinstance(x, float) else x for x in r)
    for _ in range(4):
        one, two = ([rnd.choice(pool) for _ in range(rnd.randrange(30))] for _ in range(2))
        got = {
            (r["change"], *map(str, norm(tuple(r)[2:]))): tuple(r)[1]
            for r in compare.row_difference(table(spark, one), table(spark, two), "o").toDF("change", "copies", "a", "b", "c", "d").collect()
        }
        a, b = collections.Counter(map(norm, one)), collections.Counter(map(norm, two))
        want = {("lost", *map(str, k)): n for k, n in (a - b).items()} | {("added", *map(str, k)): n for k, n in (b - a).items()}
        assert got == want
        counts = compare.difference_counts(table(spark, one), table(spark, two), "o").first()
        assert tuple(counts) == ((a - b).total(), (b - a).total(), (a & b).total())
    gone = compare.row_difference(table(spark, pool), table(spark, []), "o").toDF("change", "n", "a", "b", "c", "d")
    assert gone.agg(F.sum("n")).first()[0] == 6
    with pytest.raises(ValueError):
        compare.row_difference(table(spark, pool), table(spark, pool).drop("a"), "o")


def test_changed_cells(spark):
    nan = float("nan")
    before = spark.createDataFrame([(1, "a", 1.0, 5), (2, "b", nan, 6), (3, None, 3.0, 7), (4, "d", 4.0, 8), (None, "z", 1.0, 9)], "k int, s string, x double, n int")
    after = spark.createDataFrame([(1, "a", None, "5"), (2, "B", 2.0, "6"), (3, "c", 3.0, "x"), (9, "d", 4.0, "8"), (None, "y", 1.0, "9")], "k int, s string, x double, n string")
    got = {r["column"]: tuple(r)[1:] for r in compare.changed_cells(before, after, "k").collect()}
    assert got == {"s": (3, 2, 1, 0), "x": (3, 2, 1, 1), "n": (3, 1, 0, 0)}


def test_fleet_levels_add_up(spark):
    rows = [("d1", "s1", "a@b.com", 1), ("d1", "s1", "bad", None), ("d1", None, None, 2), (None, "s1", " ", 3), ("d2", "s1", "c@d.org", 4)]
    df = spark.createDataFrame(rows, "dataset string, sheet string, email string, n int")
    got = fleet.fleet_report(df).collect()
    one = {(r.level, r.dataset, r.sheet, r.column): (r.cells, r.missing, r.checked, r.violations) for r in got}
    assert one["all", None, None, None] == (10, 2, 3, 1)
    assert one["dataset", "d1", None, None] == (6, 2, 2, 1) and one["sheet", "d1", "s1", None] == (4, 1, 2, 1)
    assert one["sheet", "d1", None, None] == (2, 1, 0, 0) and one["dataset", None, None, None] == (2, 0, 0, 0)
    assert one["column", "d1", "s1", "email"] == (2, 0, 2, 1) == one["format", "d1", "s1", "email"]
    for level in ("dataset", "sheet", "column", "format"):
        assert sum(r.cells for r in got if r.level == level) == 10


@pytest.mark.parametrize("limit", [7, 10**9])
def test_as_of_equals_search(spark, limit):
    rnd = random.Random(limit)
    moment = lambda m: None if m is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    left = [(i, rnd.choice(["hot", "hot", "hot", "k", None, "alone"]), moment(rnd.choice([None, *range(40)]))) for i in range(300)]
    right = [(rnd.choice(["hot", "k", None, "other"]), moment(rnd.choice([None, *range(40)])), rnd.choice([None, 1, 2]), rnd.random()) for _ in range(60)]
    a = spark.createDataFrame(left, "id int, k string, ts timestamp").repartition(4)
    b = spark.createDataFrame(right, "k string, since timestamp, p int, q double")
    got = {r.id: (r.p, r.q) for r in ordered.as_of(a, b, "k", "ts", "since", ["p", "q"], limit).collect()}
    low = lambda v: (v is not None, v or 0)
    for i, k, ts in left:
        known = [r for r in right if r[0] == k and r[1] is not None and ts is not None and r[1] <= ts]
        best = max(known, key=lambda r: (r[1], low(r[2]), r[3]), default=(None,) * 4)
        assert got[i] == best[2:]


def test_calls_without_a_price_are_counted(spark):
    day = datetime.datetime
    calls = spark.createDataFrame([("a", day(2024, 1, 1), 10, 10), ("a", day(2024, 1, 3), 10, 10), ("a", None, 1, 1), ("x", day(2024, 1, 3), 5, 5)], "provider string, ts timestamp, input_tokens int, output_tokens int")
    prices = spark.createDataFrame([("a", day(2024, 1, 3), 1e6, 2e6), ("a", day(2024, 2, 3), 9.0, 9.0)], "provider string, valid_from timestamp, input_price double, output_price double")
    got = {(r.provider, r.input_price): (r.calls, r.total_tokens, r.cost) for r in usage.usage_cost_by_date(calls, prices).collect()}
    assert got == {("a", None): (2, 22, None), ("a", 1e6): (1, 20, 30.0), ("x", None): (1, 10, None)}


def test_merged_sketches(spark, tmp_path):
    root = str(tmp_path)
    whole = spark.range(60000).select(
        (F.col("id") % 20000).alias("k"), F.when(F.col("id") % 3 > 0, F.rand(1)).alias("x"), F.concat(F.lit("t"), F.col("id") % 700).alias("t"),
        F.lit(None).cast("double").alias("none"),
    ).cache()
    for part in range(3):
        sketches.write_sketches(whole.where(F.col("k") % 3 == part), root, "Book", "S", "1", str(part))
    sketches.write_sketches(whole.where("k % 3 = 0"), root, "Book", "S", "1", "0")  # written again
    sketches.write_sketches(whole.limit(0), root, "Book", "S", "2", "0")
    got = {r["column"]: r for r in sketches.merged(sketches.read_sketches(spark, root)).collect()}
    exact = {r["column"]: r["unique_count"] for r in profile.unique_count(whole).collect()}
    for c in whole.columns:
        assert got[c]["rows"] == 60000
        assert abs(got[c]["distinct"] - exact[c]) <= 0.03 * exact[c]
    assert got["x"]["non_null"] == 40000 and got["none"]["non_null"] == 0 and got["none"]["quantiles"] is None
    assert all(abs(a - b) < 0.01 for a, b in zip(got["x"]["quantiles"], (0.25, 0.5, 0.75)))
    approx = {r["column"]: r["unique_count"] for r in profile.unique_count(whole, approx=True).collect()}
    assert all(abs(approx[c] - exact[c]) <= 0.15 * exact[c] for c in exact)


def test_profile_and_loop_take_few_jobs(spark, data):
    df = data.fixture("dirty_orders")
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, "")
        run()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    assert jobs("profile", lambda: profile.column_profile(df, "row_id").collect()) <= 10
    facts = profile.TableFacts(df, "row_id")
    assert jobs("facts", lambda: (facts.rows, facts.sample, facts.repeats)) <= 7
    from gridwash.plans import suggest

    assert jobs("suggest", lambda: suggest.top_suggestions(suggest.rule_suggestions(df, "row_id", facts)).collect()) <= 2
    assert jobs("loop", lambda: apply.clean_until(df, "row_id", 95)[1].collect()) <= 44


def test_scratch_is_dropped(spark):
    import os

    kept = session.stored(spark.range(5).toDF("a"), "kept")
    gone = session.stored(spark.range(5).toDF("a"), "gone")
    folder = gone.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    session.drop_stored(gone)
    assert not os.path.exists(folder) and kept.count() == 5
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert session.drop_scratch(spark) > 0 and not os.path.exists(folder)
    assert session.drop_scratch(spark) == 0
