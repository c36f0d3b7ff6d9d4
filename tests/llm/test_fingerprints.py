"""Fingerprints: span hashes and extensions against plain text, edits against Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwash.llm import fingerprints as fp

RNG = random.Random(6)


def prose(n, alphabet="abcdefghij üß語😀"):
    return "".join(RNG.choice(alphabet) for _ in range(n))


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("chunk", [fp.CHUNK, 7])
def test_spans_and_extensions_equal_plain(monkeypatch, chunk):
    monkeypatch.setattr(fp, "CHUNK", chunk)
    a = prose(60, "ab")
    b = prose(5, "ab") + a[10:40] + prose(20, "ab")
    one, two = fp.Prefixes(a), fp.Prefixes(b)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a) + 1), np.arange(len(b) + 1)))
    ahead, behind = one.extension(i, two, j), one.extension(i, two, j, back=True)
    for x, y, f, g in zip(i, j, ahead, behind):
        assert f == common(a[x:], b[y:]) and g == common(a[:x][::-1], b[:y][::-1])
    # Different spans have different hashes, equal ones equal hashes.
    seen = {}
    for s in range(len(a)):
        for e in range(s, len(a) + 1):
            seen.setdefault(a[s:e], set()).add(int(one.span(np.int64(s), np.int64(e))))
    by_size = {}
    for text, values in seen.items():
        assert len(values) == 1
        by_size.setdefault(len(text), []).extend(values)
    assert all(len(v) == len(set(v)) for v in by_size.values())


def test_hash_of_code_points_by_definition():
    text = "a語😀\x00"
    for which, (prime, base) in enumerate(zip(fp.PRIMES, fp.BASES)):
        want = sum((ord(c) + 1) * pow(base, i, prime) for i, c in enumerate(text[1:])) % prime
        assert int(fp.Prefixes(text).span(np.int64(1), np.int64(4), which)) == want


@pytest.mark.parametrize("keep, take", [(0, 0), (0, 9), (5, 3), (40, 0), (30, 12), (16, 60), (60, 60)])
def test_joined_texts_equal_one_text(keep, take):
    a, b = prose(60), prose(60)
    joined, whole = fp.Prefixes(a).followed_by(keep, fp.Prefixes(b), take), fp.Prefixes(a[:keep] + b[:take])
    assert all((x == y).all() for x, y in zip(joined.sums, whole.sums))
    assert joined.codes.tolist() == whole.codes.tolist() and fp.fingerprint(joined) == fp.fingerprint(whole)


def mark(text):
    return fp.fingerprint(fp.Prefixes(text))


def test_likeness():
    base = prose(3000)
    assert fp.likeness(mark(base), mark(base)) == 1 and fp.likeness(mark(""), mark("")) == 1
    assert fp.likeness(mark(base), mark("")) == 0
    assert fp.likeness(mark(base), mark(prose(3000))) < 0.05
    # One change anywhere leaves nearly all of the text; so does text added at both ends.
    for at in (0, 700, 1500, 2999):
        near = fp.likeness(mark(base), mark(base[:at] + "#" + base[at + 1 :]))
        assert 0.9 < near < 1
    assert fp.likeness(mark(base), mark("#" + base + "#")) > 0.8
    # A shared prefix is seen to within a step of the larger text.
    for share in (0.25, 0.5, 0.75):
        cut = int(3000 * share)
        near = fp.likeness(mark(base), mark(base[:cut] + prose(3000 - cut)))
        assert share - 1 / 16 <= near <= share + 0.35
    for n in range(0, 70):
        a, b = mark(base[:n]), mark(base[: n + 1])
        assert a != b and 0 <= fp.likeness(a, b) < 1 and fp.likeness(a, b) == fp.likeness(b, a)


def test_repetitive_text_keeps_its_smallest_spans(monkeypatch):
    text = "x" * 5000 + prose(100) + "y" * 5000
    whole = fp.Prefixes(text).smallest().tolist()
    monkeypatch.setattr(fp, "CHUNK", 64)
    assert fp.Prefixes(text).smallest().tolist() == whole
    at = np.arange(len(text) - fp.WIDTH + 1)
    every = fp.words.mix(fp.Prefixes(text).span(at, at + fp.WIDTH, 0)) >> fp.U64(32)
    assert whole == np.unique(every)[: fp.SKETCH].tolist()


@pytest.fixture(scope="module")
def rows():
    base = prose(900)
    return [
        (9, base), (8, base), (7, ""), (6, None), (5, "a"), (4, "ab"), (3, "abc"), (2, " \t\n"), (1, base[:450] + prose(450)),
        (-3, "語" * 10 + "😀"), (2**62, "last but first"), (None, prose(30)), (0, prose(20000)), (10, base), (11, prose(40)),
    ]


def frame(spark, rows):
    data = [(i, t, "x", 1, True, "p") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, hash string, id int, known boolean, part string").repartition(3)


@pytest.mark.parametrize("part", [fp.PART, 50])
def test_edited_texts(spark, rows, part, monkeypatch):
    monkeypatch.setattr(fp, "PART", part)
    got = {r.doc_id: r for r in fp.edited_fingerprints(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, text), (j, ahead) in zip(ordered, ordered[1:] + ordered[:1]):
        text, ahead, r = text or "", ahead or "", got[i]
        n = len(text)
        edited = text[: n - n // 3] + ahead[: n // 3]
        assert (r.n_chars, r.next_id) == (n, j)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == mark(text) and r.edited_fingerprint == mark(edited)
        assert r.near_edited == fp.likeness(mark(text), mark(edited)) and r.near_next == fp.likeness(mark(text), mark(ahead))
        assert (r.common_prefix, r.common_suffix) == (common(text, ahead), common(text[::-1], ahead[::-1]))


def test_repeated_rows_single_rows_and_no_rows(spark, rows):
    one = fp.edited_fingerprints(frame(spark, rows[:1])).first()
    assert (one.next_id, one.near_next) == (9, 1.0)
    twice = rows + rows[:4] + [(9, "other"), (9, "other")]
    got = fp.edited_fingerprints(frame(spark, twice)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in twice)
    assert {r.near_next for r in fp.edited_fingerprints(frame(spark, [(1, "abc")] * 50)).collect()} == {1.0}
    assert fp.edited_fingerprints(frame(spark, rows).where("false")).count() == 0
    plain = fp.fingerprints(frame(spark, twice), name="hash").select("row.doc_id", "row.text", F.col("hash").alias("m")).collect()
    assert all(r.m == mark(r.text or "") for r in plain) and len(plain) == len(twice)


def test_bytes_that_are_no_characters(spark):
    table = spark.createDataFrame([(1, b"ab\xffc"), (2, b"\xc3")], "doc_id long, text binary")
    got = {r.doc_id: r for r in fp.edited_fingerprints(table).collect()}
    assert got[1].n_chars == 4 and got[1].fingerprint == mark("ab�c") and got[2].n_chars == 1
