"""Scores against a pandas restatement of the rules."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwash.functions import formats, rules
from gridwash.operators import score


def restated(pdf: pd.DataFrame, header_detected=False) -> dict:
    n, k = pdf.shape
    if n == 0:
        base = {"data_completeness": 0, "data_consistency": 50, "data_uniqueness": 50, "format_compliance": 70, "business_logic": 75}
    else:
        missing = pdf.isnull().sum().sum() / pdf.size
        done = max(0, 100 - missing * 100)
        base = {"data_completeness": max(done, 40) if missing < 0.9 else done}
        severe = 0
        for c in pdf.columns:
            v = pdf[c].dropna()
            if pdf[c].dtype == object and len(v) > 1:
                head = v.head(20).astype(str)
                num = sum(bool(re.match(rules.NUMBER, re.sub("[,$€£]", "", x).strip())) for x in head)
                day = sum(any(re.search(p, x) for p in rules.DATE_SEARCH) for x in head)
                parts = [p for p in (num, day, len(head) - num - day) if p > 0]
                severe += len(parts) > 2 and all(p > len(v) * 0.2 for p in parts)
        base["data_consistency"] = max(50, 85 - severe / k * 20)
        dup = pdf.duplicated().sum() / n
        single = sum(pdf[c].nunique() <= 1 and not pdf[c].isnull().all() for c in pdf)
        unique = 90 - (dup * 30 if dup > 0.7 else dup * 15 if dup > 0.5 else 0) * (n > 1)
        base["data_uniqueness"] = max(50, unique - (20 if single > k * 0.5 else 0))
        bad = cells = 0
        for c in pdf.columns:
            fmt = formats.detect_format_by_name(c)
            if fmt:
                v = pdf[c].dropna().astype(str)
                wrong = sum(x != "" and not re.match(rules.FORMATS[fmt][0], x.strip()) for x in v)
                if wrong:
                    bad, cells = bad + wrong, cells + len(v)
        base["format_compliance"] = max(40, 100 - bad / cells * 60) if bad else 100
        logic = 90
        for c in pdf.select_dtypes(include=[np.number]):
            v = pdf[c].dropna()
            if len(v) > 1:
                q1, q3 = v.quantile([0.25, 0.75])
                if q3 > q1:
                    ratio = ((v < q1 - 5 * (q3 - q1)) | (v > q3 + 5 * (q3 - q1))).mean()
                    logic -= min(ratio * 20, 10) if ratio > 0.2 else 0
        base["business_logic"] = max(60, logic) if n > 1 else 75
    s = 100 - (50 if n < 1 else 15 if n < 3 else 0) - (10 if k > 100 else 0)
    empty_rows, empty_cols = pdf.isnull().all(axis=1).sum(), pdf.isnull().all(axis=0).sum()
    s -= 20 if empty_rows > n * 0.5 else 5 if empty_rows > n * 0.3 else 0
    s -= 20 if empty_cols > k * 0.5 else 5 if empty_cols > k * 0.3 else 0
    base["structural_integrity"] = max(0, s)
    generic = sum("Unnamed" in c or "Column_" in c or not c.strip() for c in pdf) / k
    base["header_quality"] = max(50, 85 - (0 if header_detected else 15) - (generic * 30 if generic > 0.5 else generic * 15 if generic > 0.3 else 0))
    return base


def frames():
    rnd = np.random.default_rng(2)
    yield "plain", pd.DataFrame({"name": [f"n{i}" for i in range(50)], "qty": rnd.integers(0, 9, 50)})
    yield "gaps", pd.DataFrame({"a": ["x", None] * 20, "b": [None] * 40, "c": [None] * 40})
    yield "copies", pd.DataFrame({"a": ["x"] * 40 + ["y"], "b": ["z"] * 41})
    yield "half copies", pd.DataFrame({"a": [str(i % 8) for i in range(20)], "b": ["u"] * 20})
    yield "mixed", pd.DataFrame({"a": ["1", "2024-01-02", "word"] * 6, "b": [str(i) for i in range(18)]})
    yield "outliers", pd.DataFrame({"a": [float(i % 10) for i in range(70)] + [1e6] * 25, "b": range(95)})
    yield "formats", pd.DataFrame({"email": ["a@b.co", "no", ""] * 5, "order_date": ["01/02/2024", "2024-01-02", None] * 5})
    yield "generic", pd.DataFrame({"Column_1": ["a"] * 2 + ["b"], "Unnamed: 2": ["c", "d", "e"], "ok": ["f", "g", "h"]})
    yield "one row", pd.DataFrame({"a": ["x"], "b": [1.5]})


@pytest.mark.parametrize("name, pdf", list(frames()), ids=[n for n, _ in frames()])
@pytest.mark.parametrize("header", [False, True])
def test_dimensions_equal_restatement(spark, name, pdf, header):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    types = {"object": "string", "int64": "bigint", "float64": "double"}
    schema = "ord bigint, " + ", ".join(f"`{c}` {types[str(t)]}" for c, t in pdf.dtypes.items())
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    out = score.dimension_scores(score.measure(df, "ord", header)).withColumn("total", score.total_score())
    got, want = out.first(), restated(pdf, header)
    for d in score.DIMENSIONS:
        assert got[d] == pytest.approx(want[d], abs=1e-9), d
    assert got["total"] == int(sum(want[d] * w for d, w in rules.WEIGHTS.items()))
    assert 0 <= got["total"] <= 100


def test_empty_table(spark):
    df = spark.createDataFrame([], "ord bigint, a string, b double")
    report = score.quality_report(df, "ord").first()
    want = restated(pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=float)}))
    assert dict(report["detailed_scores"]) == pytest.approx(want)
    assert report["stats"] == {"status": "Empty dataset"}


def test_levels_and_bands(spark):
    df = spark.createDataFrame([(s,) for s in (0, 24, 25, 44, 45, 64, 65, 79, 80, 100)], "s int")
    rows = df.select("s", score.quality_level(F.col("s")).alias("l"), score.score_band(F.col("s"), "file").alias("f")).collect()
    assert [r["l"] for r in rows] == ["POOR"] * 2 + ["FAIR"] * 2 + ["GOOD"] * 2 + ["VERY_GOOD"] * 2 + ["EXCELLENT"] * 2
    assert [r["f"] for r in rows] == ["garbage"] * 2 + ["garbage", "poor", "poor", "fair", "fair", "good", "good", "excellent"]


def test_cost_unit_vectors(spark):
    from gridwash.operators import usage

    rows = [("a", 5000, 2000), ("a", 15000, 6000)]
    calls = spark.createDataFrame(rows, "provider string, input_tokens bigint, output_tokens bigint")
    assert usage.usage_cost(calls.limit(1)).first()["cost"] == pytest.approx(0.045)
    assert usage.usage_cost(calls).first()["cost"] == pytest.approx(0.18)
