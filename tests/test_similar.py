"""Exact near-duplicates and spelling within k edits against brute force."""

import random
import re

import pytest

from gridwash import session
from gridwash.operators.catalogue import consistency, duplicates
from tests.test_scale import levenshtein


def shingles(text, words=3):
    t = re.sub(r"[\W_]+", " ", text.lower()).strip()
    w = t.split(" ")
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if t else set()


def brute(rows, threshold=0.8):
    """{id: (smallest like id below it, similarity)}; ids are distinct."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None and t is not None]
    out = {}
    for i, a in sets:
        for j, b in sets:
            if a and b and j < i:
                similar = len(a & b) / len(a | b)
                if similar >= threshold and (i not in out or j < out[i][0]):
                    out[i] = (j, similar)
    return out


def found(spark, rows, kind="bigint", threshold=0.8):
    df = spark.createDataFrame(rows, f"id {kind}, text string").repartition(5)
    return {r["id"]: (r["near_duplicate_of"], r["similarity"]) for r in duplicates.similar_texts(df, "id", "text", threshold).collect()}


def template_texts(rnd):
    """600 forms of one letter with their own fields, and 60 near copies of some."""
    body = [f"clause{i}" for i in range(60)]
    texts = []
    for k in range(600):
        own = list(body)
        for at in rnd.sample(range(60), rnd.choice([3, 5, 7])):
            own[at] = f"field{k}x{at}"
        texts.append(" ".join(own))
    for k in rnd.sample(range(600), 60):
        own = texts[k].split()
        own[rnd.randrange(60)] = "edited"
        texts.append(" ".join(own))
    return texts


def test_template_texts_equal_brute_force(spark):
    rows = list(enumerate(template_texts(random.Random(7))))
    want = brute(rows)
    assert len(want) >= 60
    assert found(spark, rows) == want


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_messy_texts_equal_brute_force(spark, kind):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(120)]
    base = [rnd.choice(vocabulary) for _ in range(80)]
    texts = [None, "", " ... ", "one", "One!", "one two", "ONE, two", "x" * 5000, "é ü", "É-ü"]
    for _ in range(60):  # a hot group: copies, and copies with some changes
        own = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            own[rnd.randrange(80)] = rnd.choice(vocabulary)
        texts.append(rnd.choice([" ", ", "]).join(own))
    for i in range(40):  # a chain: neighbours are alike, ends are not
        base[rnd.randrange(80)] = f"step{i}"
        texts.append(" ".join(base))
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    rnd.shuffle(texts)
    ids = list(range(len(texts)))
    rows = [(f"k{i:04d}" if kind == "string" else i, t) for i, t in zip(ids, texts)] + [(None, texts[20])]
    assert found(spark, rows, kind) == brute(rows)
    assert found(spark, rows, kind, 0.5) == brute(rows, 0.5)


def test_texts_of_their_own_are_set_aside(spark):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(10_000)}" for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    for k in rnd.sample(range(400), 40):  # about the threshold, at all sizes
        own = texts[k].split()
        cut = rnd.randint(0, max(1, len(own) // 8))
        texts.append(" ".join(own[cut:] + [f"new{k}"] * rnd.randint(0, 3)))
    rows = list(enumerate(texts))
    old = set(session.scratch_tables(spark))
    want = brute(rows)
    assert found(spark, rows) == want and 5 < len(want) < 40
    full = [p for p in session.scratch_tables(spark) if p not in old and "/sets-" in p]
    assert [spark.read.parquet(p).count() < 150 for p in full] == [True]


def test_no_texts_and_repeated_ids(spark):
    assert found(spark, []) == {} and found(spark, [(1, None), (2, "")]) == {}
    assert found(spark, [(1, "a b c d"), (1, "a b c d"), (2, "A b-c d"), (3, "other")]) == {2: (1, 1.0)}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_corrections_equal_brute_force(spark, edits):
    rnd = random.Random(edits)
    good = {"", "a", "of", "red", "green", "blue", "bluer", "naïve", "anti-corruption", "straße", "x" * 60, "abcabcabc"}
    count = {g: 20 + rnd.randrange(3) for g in good}
    rare = set()
    for g in good:
        for _ in range(25):
            w = list(g)
            for _ in range(rnd.randint(1, edits + 1)):
                at, op = rnd.randrange(len(w) + 1), rnd.randrange(3)
                w[at : at + (op > 0)] = [rnd.choice("abcdeïx")] * (op < 2)
            rare.add("".join(w))
    rare |= {"zzzzzzzz", "q", "qq", "qqq"}
    rows = [(g,) for g in good for _ in range(count[g])] + [(r,) for r in rare - good] + [(None,)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "w string")
    got = {r["value"]: r["correction"] for r in consistency.spelling_corrections(df, "w", 10, edits).collect()}
    want = {}
    for r in rare - good:
        near = [(levenshtein(r, g), -count[g], g) for g in good if levenshtein(r, g) <= edits]
        if near:
            want[r] = min(near)[2]
    assert got == want and len(want) > 50
    fixed = consistency.fix_spelling(df, "w", 10, edits)
    assert fixed.count() == len(rows) and {r[0] for r in fixed.collect()} == good | {None} | (rare - good - set(want))
