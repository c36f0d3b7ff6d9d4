"""Cell functions against plain Python on generated texts and fixed vectors."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F, types as T

from gridwash.functions import cells, formats, rules


def one(spark, values, make, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    out = df.select("v", make(F.col("v")).alias("r")).collect()
    return {r["v"]: r["r"] for r in out}


def random_texts(n=400, seed=7):
    rnd = random.Random(seed)
    alphabet = "ab1 ,.-/$%\t\n  é₹"
    return sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8))) for _ in range(n)})


def test_trim_is_python_strip(spark):
    texts = random_texts()
    assert one(spark, texts, cells.trim_text) == {t: t.strip() for t in texts}


def test_number_rule(spark):
    def rule(t):
        plain = t.translate({ord(c): None for c in ",$€£"}).strip()
        return bool(re.match(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$", plain))

    texts = random_texts(seed=3) + ["1,234.5", "$ 3", "1e5", "-.5", "+7.", "1_000", "nan", "1.0f", "x1"]
    assert one(spark, texts, cells.is_number) == {t: rule(t) for t in texts}


@pytest.mark.parametrize(
    "text, day_first, bare, expected",
    [
        ("1999-02-01", True, False, dt.datetime(1999, 2, 1)),
        ("1999/2/1", True, False, dt.datetime(1999, 2, 1)),
        ("03/10/1998", True, False, dt.datetime(1998, 10, 3)),
        ("03/10/1998", False, False, dt.datetime(1998, 3, 10)),
        ("25/12/1998", False, False, dt.datetime(1998, 12, 25)),
        ("28-05-97", True, False, dt.datetime(1997, 5, 28)),
        ("01-01-24", True, False, dt.datetime(2024, 1, 1)),
        ("01-01-68", True, False, dt.datetime(2068, 1, 1)),
        ("01-01-69", True, False, dt.datetime(1969, 1, 1)),
        ("5-Jan-2024", True, False, dt.datetime(2024, 1, 5)),
        ("5-JAN-99", True, False, dt.datetime(1999, 1, 5)),
        ("March 7, 2020", True, False, dt.datetime(2020, 3, 7)),
        ("Mar 7 2020", True, False, dt.datetime(2020, 3, 7)),
        (" 2024-01-15 10:20:30 ", True, False, dt.datetime(2024, 1, 15, 10, 20, 30)),
        ("15/01/2024 10:20:30", True, False, dt.datetime(2024, 1, 15, 10, 20, 30)),
        ("31/02/2024", True, False, None),
        ("1998", True, False, None),
        ("1998", True, True, dt.datetime(1998, 1, 1)),
        ("20240101", True, True, dt.datetime(2024, 1, 1)),
        ("9999", True, True, None),
        ("unknown", True, True, None),
        ("5-LOW", True, True, None),
        ("12:30:00", True, True, None),
        ("", True, True, None),
    ],
)
def test_parse_datetime(spark, text, day_first, bare, expected):
    got = one(spark, [text], lambda c: cells.parse_datetime(c, day_first, bare))
    assert got[text] == expected


def test_type_tags(spark):
    got = one(spark, ["12/3", "1,2", "abc", "a-b", "", None], cells.type_tag)
    assert got == {"12/3": "date-like", "1,2": "numeric-string", "abc": "text", "a-b": "text", "": "text", None: None}


def test_looks_like_data(spark):
    got = one(spark, ["Name", "12", "$1,000", "2024-01-01", "x" * 51, "(+) 5%", "", None], cells.looks_like_data)
    assert [k for k, v in got.items() if v] == ["12", "$1,000", "2024-01-01", "x" * 51, "(+) 5%"]


def test_safe_str_has_no_exponent(spark):
    got = one(spark, [12345678.5, 3.0, 0.1, -2.25], lambda c: cells.safe_str(c, T.DoubleType()), "v double")
    assert got == {12345678.5: "12345678.5", 3.0: "3.0", 0.1: "0.1", -2.25: "-2.25"}


def test_json_and_bool(spark):
    got = one(spark, ['say {"k": {"a": 1}} bye', "none"], lambda c: cells.json_field(c, "$.k.a"))
    assert got == {'say {"k": {"a": 1}} bye': "1", "none": None}
    assert one(spark, ["TRUE", "yes", None], lambda c: cells.parse_bool(c, True)) == {
        "TRUE": True, "yes": False, None: True,
    }


@pytest.mark.parametrize("fmt", list(rules.FORMATS))
def test_format_examples_are_valid(spark, fmt):
    example = rules.FORMATS[fmt][2]
    got = one(spark, [example, f"  {example}\t", "", None, "?!"], lambda c: formats.is_valid(c, fmt))
    assert got == {example: True, f"  {example}\t": True, "": True, None: True, "?!": False}


@pytest.mark.parametrize("name", list(rules.PATTERNS))
def test_pattern_examples_match(spark, name):
    example = rules.PATTERNS[name][2]
    got = one(spark, [example, example.lower(), f" {example} ", "?!"], lambda c: formats.matches_pattern(c, name))
    assert got == {example: True, example.lower(): True, f" {example} ": True, "?!": False}


def test_date_range_is_not_the_calendar(spark):
    got = one(
        spark,
        ["31/02/2024", "32/01/2024", "01/13/2024", "00/01/2024", "01/01/1899", "01/01/2100", "01/01/2101"],
        lambda c: formats.is_valid(c, "date"),
    )
    assert [k for k, v in got.items() if v] == ["31/02/2024", "01/01/2100"]


@pytest.mark.parametrize(
    "fmt, value, expected",
    [
        ("date", "1-2-24", "01/02/2024"),
        ("date", "1/2/97", "01/02/2097"),
        ("date", "2024-1-5", "05/01/2024"),
        ("date", "5-1-2024", "05/01/2024"),
        ("date", "1/2-97", "1/2-97"),
        ("date", "soon", "soon"),
        ("phone", "98765 43210", "+91-9876543210"),
        ("phone", "919876543210", "+91-9876543210"),
        ("phone", "+91 98765-43210", "+91-9876543210"),
        ("phone", "12345", "12345"),
        ("gst", " 27aabcu9603r1zp", "27AABCU9603R1ZP"),
        ("currency_inr", "$1234.5", "₹ 1,234.50"),
        ("currency_inr", "n/a", "n/a"),
        ("percentage", "18", "18.0%"),
        ("percentage", "18.5", "18.5%"),
        ("percentage", "18.5%", "18.5%"),
        ("email", " a@b.co ", "a@b.co"),
    ],
)
def test_standardize_value(spark, fmt, value, expected):
    assert one(spark, [value], lambda c: formats.standardize_value(c, fmt)) == {value: expected}


def test_suggest_fix(spark):
    got = one(spark, ["abcde1234f", "123456789012", "98765-43210", "919876543210", "x"], formats.suggest_fix)
    assert got["abcde1234f"] == ["Possible PAN: ABCDE1234F"]
    assert got["123456789012"] == ["Possible Aadhaar: 1234 5678 9012"]
    assert got["98765-43210"] == ["Possible Mobile: +91-9876543210"]
    assert got["919876543210"] == ["Possible Aadhaar: 9198 7654 3210", "Possible Mobile: +91-9876543210"]
    assert got["x"] == []


def test_name_words():
    find = formats.detect_format_by_name
    assert find("Order Date") == "date" and find("hotel") == "phone" and find("company") == "pan"
    assert find("hotel", word_match=True) is None and find("tel no", word_match=True) == "phone"
    assert find("qty") is None
