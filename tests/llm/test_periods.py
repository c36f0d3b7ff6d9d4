"""Periodic runs against a search of all starts and periods."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from gridwash.llm import periods
from gridwash.llm.queries import ORACLE, QUERIES


def plain_runs(w):
    out, n = set(), len(w)
    for q in range(1, n // periods.TIMES + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(periods.LEAST, periods.TIMES * q) and j > i:
                stretch = w[i : j + q]
                if not any(stretch[:-p] == stretch[p:] for p in range(1, q)):
                    out.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_planted(w, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_plain_search(letters):
    rng = random.Random(letters)
    rows = []
    for _ in range(120):
        w = []
        while len(w) < rng.randrange(0, 90):
            piece = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
            w += piece * rng.choice([1, 1, 2, 4, 5, 9]) + piece[: rng.randrange(len(piece) + 1)]
        rows.append(w)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in rows])])
    got = periods.find_runs(np.array(sum(rows, []), np.int64), bounds)
    want = [(bounds[k] + s, length, q) for k, w in enumerate(rows) for s, length, q in plain_runs(w)]
    assert [tuple(r) for r in got] == want and (letters > 3 or want)


def test_long_periods_and_long_rows():
    rng = np.random.default_rng(2)
    block = rng.integers(0, 10**6, 3000)
    w = np.concatenate([rng.integers(0, 10**6, 500), np.tile(block, 5)[:13000], rng.integers(0, 10**6, 77), np.zeros(40000, np.int64)])
    got = periods.find_runs(w, np.array([0, len(w)]))
    assert [tuple(r) for r in got] == [(500, 13000, 3000), (13577, 40000, 1)]
    assert len(periods.find_runs(np.zeros(0, np.int64), np.array([0, 0, 0]))) == 0


@pytest.mark.parametrize("plant", [True, False])
def test_collapse(spark, plant, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \t\r\n ", "one", "a b " * 7, "x\x0by\x0c" * 4, "la " * 6, "la " * 5, "é ü " * 50 + "end", "  " * 9, "w" * 5000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(200))) for _ in range(60)]
    data = [(i, t, "r", 1, 2) for i, t in enumerate(texts)] + [(None, "b a " * 20, "r", 1, 2), (4, texts[4], "r", 1, 2)]
    table = spark.createDataFrame(data, "doc_id long, text string, row string, runs int, period int").repartition(3)
    got = sorted(
        str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed).decode(), r.p))
        for r in periods.collapse_runs(table, plant=plant).selectExpr("row.doc_id", "n_words", "runs", "collapsed", "row.period p").collect()
    )
    want = []
    for i, t, *_ in data:
        w = [x.decode() for x in (t or "").encode().split()]
        w = plain_planted(w, i) if plant and i is not None else w
        want.append(str((i, len(w), plain_runs(w), collapsed(w, plain_runs(w)), 2)))
    assert got == sorted(want)
    assert periods.collapse_runs(table.where("false")).count() == 0


def test_query_equals_plain_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_periodic_runs"](spark, sf).orderBy("doc_id").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert [tuple(r) for r in got] == con.sql(ORACLE["op13_periodic_runs"]).order("doc_id").fetchall()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r, d in zip(got[:60], spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()):
        w = plain_planted([x.decode() for x in d.text.encode().split()], d.doc_id)
        runs = plain_runs(w)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == sha(collapsed(w, runs))
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
