"""The registered queries and the pipeline on the smallest data, against plain versions."""

import math

import pytest

import corpus_pipeline
from gridwash.llm import phrases
from gridwash.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_benchmark_phrases(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op6_benchmark_phrases"](spark, SF).orderBy("doc_id").collect()
    want = [
        (d, n, h, len(f), brute.sha(",".join(sorted(map(str, f)))), h > 0) for d, n, h, f in brute.phrases(documents, items)
    ]
    assert [tuple(r)[:6] for r in got] == want
    near = brute.near_phrases(documents[:60], items, 10, phrases.NEAR)
    assert {r.doc_id: r.n_near for r in got[:60]} == {d: len(n) for d, (_, n) in near.items()}


def test_repeated_strings(spark, documents):
    import hashlib

    got = QUERIES["op7_repeated_strings"](spark, SF).orderBy("doc_id").collect()
    want = brute.repeats([t for _, t in documents], 400)
    passages = brute.repeats([t for _, t in documents], 200, 51)
    assert [tuple(r) for r in got] == [
        (d, n, g, s, hashlib.sha256(k).hexdigest(), p) for (d, _), (n, g, s, k), (_, _, p, _) in zip(documents, want, passages)
    ]


def test_near_duplicates(spark, documents):
    got = QUERIES["op10_near_duplicates"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(d, n, c, d == c) for d, n, c in brute.near(documents)]


def test_scores_beat_unigrams_on_held_out_texts(spark):
    rows = QUERIES["op9_bilinear_scores"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)
    assert all(math.isfinite(r.score) for r in rows)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op2_quality_classifier"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5
    near = steps["MinHash near-dedup"](spark, docs, SF)
    assert sorted(r.doc_id for r in near.collect()) == [d for d, _, c in brute.near(documents) if d == c]
    cut = steps["suffix-array dedup"](spark, docs, SF)
    length, words = corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS
    kept = brute.repeats([t for _, t in documents], length, words)
    want = {d: k.decode("utf-8", "ignore") for (d, _), (_, _, _, k) in zip(documents, kept)}
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = steps["benchmark decontamination"](spark, docs, SF)
    assert sorted(r.doc_id for r in clean.collect()) == [d for d, _, h, _ in brute.phrases(documents, items) if not h]
    for out in (near, cut, clean, steps["quality classifier"](spark, docs, SF)):
        assert out.columns == columns
    final = corpus_pipeline.run(spark, SF)
    assert 0 < final.count() < len(documents)
