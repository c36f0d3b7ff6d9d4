"""The paths taken on large or skewed tables, forced on small ones and compared with
brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwash.operators import ordered, profile, sampling
from gridwash.operators.catalogue import consistency, duplicates, gaps, structural
from gridwash.operators.quantiles import exact_quantiles
from registry import QUERIES


def test_quantiles_by_rank_equal_numpy(spark):
    rnd = np.random.default_rng(5)
    # A third of all values are equal, and the ranks next to that run are hit.
    values = np.concatenate([rnd.normal(size=4000).round(3), np.full(2000, 0.25)])
    pdf = pd.DataFrame({"a": values, "b": rnd.integers(0, 5, len(values)).astype(float)})
    pdf.loc[::11, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = (0.0, 0.1, 0.25, 0.5, 0.58, 0.75, 0.999, 1.0)
    got = exact_quantiles(df, ["a", "b"], probs, limit=50)
    for c in ("a", "b"):
        want = np.quantile(pdf[c].dropna(), probs)
        assert np.allclose(got[c], want, rtol=0, atol=1e-12), c


def test_quantile_jobs_do_not_grow_with_columns(spark):
    rnd = np.random.default_rng(6)
    pdf = pd.DataFrame(rnd.normal(size=(3000, 12)), columns=[f"c{i}" for i in range(12)])
    df = spark.createDataFrame(pdf).cache()
    df.count()
    jobs = []
    for n in (2, 12):
        spark.sparkContext.setJobGroup(f"quantiles{n}", "")
        got = exact_quantiles(df, list(pdf.columns[:n]), limit=100)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"quantiles{n}")))
        assert np.allclose(got["c1"], np.quantile(pdf["c1"], (0.25, 0.5, 0.75)), rtol=0, atol=1e-12)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2


def test_quantiles_of_empty_and_single(spark):
    df = spark.createDataFrame([(None, 3.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], (0.25, 0.75)) == {"a": [None, None], "b": [3.0, 3.0]}


def skewed_events(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 30)}"
        value = None if rnd.random() < 0.5 else rnd.randint(0, 99)
        rows.append((i, key if rnd.random() > 0.02 else None, value))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "ord bigint, key string, value bigint"), rows


@pytest.mark.parametrize("backward", [False, True])
def test_chunked_fill_equals_pandas(spark, backward):
    df, rows = skewed_events(spark)
    pdf = pd.DataFrame(rows, columns=["ord", "key", "value"]).sort_values("ord")
    grouped = pdf.groupby("key", dropna=False)["value"]
    pdf["want"] = grouped.bfill() if backward else grouped.ffill()
    fill = gaps.backward_fill if backward else gaps.forward_fill
    for limit in (10, 10**9):
        got = fill(df, "key", "ord", "value", group_limit=limit).orderBy("ord").toPandas()
        assert got["value"].fillna(-1).tolist() == pdf["want"].fillna(-1).tolist()


def test_chunked_running_total_equals_pandas(spark):
    df, rows = skewed_events(spark)
    df = df.withColumn("value", F.coalesce("value", F.lit(1)))
    pdf = pd.DataFrame(rows, columns=["ord", "key", "value"]).sort_values("ord").fillna({"value": 1})
    pdf["total"] = pdf.groupby("key", dropna=False)["value"].cumsum()
    pdf["delta"] = pdf.groupby("key", dropna=False)["value"].diff().fillna(0)
    for limit in (10, 10**9):
        got = ordered.running_total(df, "key", "ord", "value", "total", "delta", limit)
        got = got.orderBy("ord").toPandas()
        assert got["total"].tolist() == pdf["total"].tolist()
        assert got["delta"].tolist() == pdf["delta"].tolist()


def test_small_limits_need_few_bounds(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGES", 4)
    df, rows = skewed_events(spark, 1200)
    cut = ordered.chunked(df, "key", "ord", 3)
    assert cut.select("_chunk").distinct().count() <= 4
    assert cut.groupBy("key", "_chunk", "_part").count().agg(F.max("count")).first()[0] == 3
    pdf = pd.DataFrame(rows, columns=["ord", "key", "value"]).sort_values("ord")
    grouped = pdf.groupby("key", dropna=False)["value"]
    for fill, want in ((gaps.forward_fill, grouped.ffill()), (gaps.backward_fill, grouped.bfill())):
        got = fill(df, "key", "ord", "value", group_limit=3).orderBy("ord").toPandas()
        assert got["value"].fillna(-1).tolist() == want.fillna(-1).tolist()
    known = df.withColumn("value", F.coalesce("value", F.lit(1)))
    got, whole = (
        ordered.running_total(known, "key", "ord", "value", "total", "delta", limit).orderBy("ord").collect()
        for limit in (3, 10**9)
    )
    assert got == whole


def test_bounds_of_the_chunked_fill_do_not_grow(spark, monkeypatch, tmp_path):
    counts, plain = [], ordered._chunk_number
    monkeypatch.setattr(ordered, "_chunk_number", lambda place, bounds: counts.append(len(bounds)) or plain(place, bounds))
    for n in (20_000, 40_000):
        kind = F.when(F.col("id") % 10 > 0, "hot").alias("event_type")
        events = spark.range(n).select(F.col("id").alias("event_id"), kind, (F.col("id") % 101).cast("double").alias("value"))
        events.write.parquet(f"{tmp_path}/{n}/events.parquet")
        got = QUERIES["k40_forward_fill_chunked"](spark, f"{tmp_path}/{n}").orderBy("event_id").toPandas()
        pdf = events.orderBy("event_id").toPandas()
        pdf.loc[pdf["event_id"] % 7 < 3, "value"] = None
        want = pdf.groupby("event_type", dropna=False)["value"].ffill()
        assert got["value"].fillna(-1).tolist() == want.fillna(-1).tolist()
    assert len(counts) == 2 and max(counts) < 256


def test_first_k_of_a_large_table(spark, monkeypatch):
    df = spark.range(20_000).select(
        "id",
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("dense"),
        F.when(F.col("id") % 4000 == 3999, F.col("id").cast("string")).alias("sparse"),
        F.lit(None).cast("string").alias("never"),
    )
    plain = sampling.first_k(df, ["dense", "sparse", "never"], "id", 4).collect()
    monkeypatch.setattr(sampling, "_HEAD", 100)
    large = sampling.first_k(df, ["dense", "sparse", "never"], "id", 4).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, large))
    assert len(plain) == 8


def test_first_distinct_equals_pandas(spark, monkeypatch):
    rows = [(i, str(i), "ab"[i % 2], "z" if i else None, None if i < 90 else str(i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "o int, uniq string, two string, one string, late string")
    cols = ["uniq", "two", "one", "late"]
    want = {c: df.toPandas()[c].dropna().drop_duplicates().head(3).tolist() for c in cols}
    for head in (8, 1000):
        monkeypatch.setattr(sampling, "_DISTINCT_HEAD", head)
        got = {c: [] for c in cols}
        for r in sampling.first_distinct(df, cols, "o", 3).orderBy("column", "pos").collect():
            got[r["column"]].append(r["value"])
        assert got == want


def test_row_json_tells_times_apart(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00.000001' AS t, 0.0D AS x, 'a' AS s UNION ALL "
                   "SELECT timestamp_ntz'2024-01-01 00:00:00.000002', 0.0D, 'a' UNION ALL "
                   "SELECT timestamp_ntz'2024-01-01 00:00:00.000002', -0.0D, 'a'")
    for digest in (False, True):
        assert profile.duplicate_rows(df, digest=digest).first()[0] == 1


def test_digest_counts_like_rows(spark):
    rows = [(None, "a"), ("a", None), (None, "a"), ("a", ""), ("a", None), ("", "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    for digest in (False, True):
        assert profile.duplicate_rows(df, digest=digest).first()[0] == 2


def words(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rnd.randint(0, 50)) for _ in range(n))


def test_minhash_finds_planted_copies(spark):
    rnd = random.Random(3)
    texts = [words(rnd, 60) for _ in range(40)]
    rows = list(enumerate(texts))
    # A hot group: a third of all rows are near copies of text 0.
    for i in range(20):
        parts = texts[0].split()
        parts[rnd.randint(5, 55)] = "changed"
        rows.append((100 + i, " ".join(parts)))
    rows.append((200, texts[5].upper() + "!"))
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {
        r["id"]: r["near_duplicate_of"]
        for r in duplicates.near_duplicates_minhash(df, "id", "text", 0.7).collect()
    }
    assert got[200] == 5
    group = {0, *range(100, 120)}
    assert all(got.get(i) in group and got[i] < i for i in range(100, 120))
    assert not set(got) & set(range(40))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_spelling_equals_brute_force(spark):
    rnd = random.Random(9)
    good = ["red", "rod", "green", "blue", "a", "bluer"]
    rows = [(w,) for w in good for _ in range(20 + len(w))]
    rare = ["rd", "rad", "gren", "grene", "bleu", "blu", "x", "", "redd", "greenish", "ab"]
    rows += [(w,) for w in rare]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "w string")
    got = {r["value"]: r["correction"] for r in consistency.spelling_corrections(df, "w", 10).collect()}
    want = {}
    for r in rare:
        close = [g for g in good if levenshtein(r, g) <= 1]
        if close:
            want[r] = min(close, key=lambda g: (-(20 + len(g)), g))
    assert got == want


def test_merged_ranges_fill(spark):
    grid = spark.createDataFrame([("s", 0, 0, "top"), ("s", 1, 0, None), ("s", 3, 1, "x")], "sheet string, row int, col int, value string")
    ranges = spark.createDataFrame([("s", 0, 1, 0, 1)], "sheet string, min_row int, max_row int, min_col int, max_col int")
    got = {(r["row"], r["col"]): r["value"] for r in structural.fill_merged_cells(grid, ranges).collect()}
    assert got == {(0, 0): "top", (0, 1): "top", (1, 0): "top", (1, 1): "top", (3, 1): "x"}


def test_hot_key_stays_pruned_before_the_shuffle(spark):
    """Keeping one row per key must limit each task before rows move."""
    df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").alias("ord"))
    plan = duplicates.deduplicate(df, "k", "ord")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    sample = sampling._top(df.select("ord", F.col("k")), ["k"], ["ord"], 5)
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()
