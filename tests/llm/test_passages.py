"""Repeated strings of other lengths than 400 bytes, and passages of some words."""

import random

import pytest

import corpus_pipeline
from gridwash.llm import repeats
from tests.llm import brute

RNG = random.Random(12)
WORDS = [f"w{i}" for i in range(300)] + ["Äther", "été"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def passage_texts():
    shared = [prose(RNG.randint(20, 90)) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [prose(RNG.randint(0, 40)), RNG.choice(shared), prose(RNG.randint(0, 40)), RNG.choice(shared), prose(RNG.randint(0, 9))]
        texts.append(RNG.choice([" ", "\n", "  "]).join(parts))
    return texts + ["", "x" * 700, "ab" * 300, "one two", "é" * 300, texts[0]]


def rows_of(frame):
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in frame.orderBy("row.doc_id").collect()]


@pytest.mark.parametrize("length, least", [(64, 0), (97, 0), (200, 0), (200, 51), (64, 30), (400, 51)])
def test_other_lengths_equal_brute_force(spark, length, least):
    texts = passage_texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = rows_of(repeats.find_repeats(table, length=length, least_words=least))
    want = brute.repeats(texts, length, least)
    assert got == want
    assert sum(n > 0 for _, n, _, _ in want) > 3


@pytest.mark.parametrize("length, smaller, least", [(400, 200, 51), (150, 64, 20), (200, 200, 0)])
def test_strings_and_passages_equal_brute_force(spark, length, smaller, least):
    texts = passage_texts() + [None, "x" * 399, "y" * 450]
    data = [(i, t, 1, "s", 2, b"t", 3) for i, t in enumerate(texts)] + [(3, texts[3], 1, "s", 2, b"t", 3)]
    names = "doc_id long, text string, longest int, seen string, n_passages int, kept binary, row int"
    table = spark.createDataFrame(data, names).repartition(3)
    got = repeats.repeats_and_passages(table, length=length, passage_bytes=smaller, passage_words=least).selectExpr(
        "row.doc_id", "row.row", "absent", "n_bytes", "n_removed", "n_spans", "kept", "n_passages").collect()
    all_texts = [t for _, t, *_ in data]
    want = [
        (i, 3, t is None, n, g, k, bytes(kept), p)
        for (i, t, *_), (n, g, k, kept), (_, _, p, _) in zip(data, brute.repeats(all_texts, length), brute.repeats(all_texts, smaller, least))
    ]
    assert sorted(map(str, [(*r[:6], bytes(r[6]), r[7]) for r in got])) == sorted(map(str, want))
    assert repeats.repeats_and_passages(table.where("false")).count() == 0


def test_strings_below_the_shortest_are_refused(spark):
    with pytest.raises(ValueError, match="at least 64"):
        repeats.find_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=63)


def test_the_stage_cuts_51_words_and_leaves_50(spark):
    long, short = prose(51), prose(50)
    rows = [(i, f"{prose(30)} {i}. {long} {i}, {prose(20)} {i}; {short} {i}- {prose(9)}", "en", "s", 0) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.cut_repeats(spark, table, "")
    assert out.columns == table.columns
    for r in out.collect():
        before = rows[r.doc_id][1]
        assert long not in r.text and short in r.text and r.n_chars == len(r.text)
        # Only the passage and what equals around it are gone.
        assert len(before) - len(r.text) <= len(long) + 8


def test_stage_on_messy_and_empty_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, extra string"
    base = prose(120)
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, None), (3, base, "en", None, 7, "b"), (None, base, None, "s", None, "c"),
            (3, base, "en", None, 7, "b"), (4, " \n ", "en", "s", 3, "d")]
    table = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.cut_repeats(spark, table, "")
    assert out.columns == table.columns and out.schema == table.schema
    got = sorted(str(tuple(r)) for r in out.collect())
    assert got == sorted(str(t) for t in [
        (1, None, None, None, None, "a"), (2, "", "en", "s", 0, None), (3, "", "en", None, 0, "b"), (None, "", None, "s", 0, "c"),
        (3, "", "en", None, 0, "b"), (4, " \n ", "en", "s", 3, "d")])
    assert corpus_pipeline.cut_repeats(spark, table.where("false"), "").count() == 0


def test_pipeline_on_messy_and_empty_tables(spark, tmp_path):
    good = [prose(80) for _ in range(30)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t), "x") for i, t in enumerate(good)]
    rows += [(40, None, None, None, None, None), (41, "", "en", "a", 0, "x"), (None, prose(60), "en", "b", 1, "x"), (3, good[3], "en", "a", 5, "y"),
             (42, prose(20000), "en", "a", 1, "x"), (43, good[5] + " more", "en", "a", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string")
    labels = [(i, 1, 0) for i in range(0, 20)] + [(50, 0, 1), (None, 1, None), (2, None, 0)]
    items = [(1, " ".join(good[7].split()[10:30])), (None, None), (2, "")]
    for name, frame in (
        ("documents", docs), ("empty", docs.where("false")),
        ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame(items, "item_id long, text string")),
    ):
        frame.write.parquet(str(tmp_path / "full" / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "full"))
    ids = [r.doc_id for r in out.collect()]
    assert 7 not in ids and 43 not in ids and {0, 1, 42} <= set(ids) and ids.count(3) == 1
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / "full" / f"{name}.parquet")).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    docs.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
