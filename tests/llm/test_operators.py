"""Operators on messy tables: nulls, empty and very long texts, ties and repeated rows,
empty tables, extra columns with clashing names; results against plain versions."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwash.llm import (
    bilinear, licenses, minhash, mixing, neighbours, phrases, quality, repeats, token_counts, transcripts, words,
)
from tests.llm import brute

SCHEMA = (
    "doc_id long, text string, source string, size string, key long, row string, n int, segment string, "
    "list string, root string, score double, uid string, rank int, word string"
)
RNG = random.Random(4)
WORDS = [f"w{i}" for i in range(400)] + ["Äther", "été", "naïve"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(300)
    edited = base.split()
    edited[150] = "CHANGED"
    passage = prose(120)
    out = [
        (1, base), (2, base.upper()), (3, " ".join(edited)), (4, None), (5, ""), (5, ""), (6, " \t\n "), (7, "one"),
        (8, "ONE"), (None, prose(50)), (None, None), (9, prose(40) + "\n" + passage), (10, passage + " " + prose(60)),
        (11, "abc " * 500), (12, "x" * 900), (13, "ab" * 700), (14, prose(30000)), (15, prose(80)), (15, prose(80)),
    ]
    out += [(20, base), (20, base), (21, prose(700) + " " + base)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, ["a", "b", None][k % 3], "s", 1, "r", 2, "g", "l", "t", 0.5, "u", 3, "w") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_hashes_tell_words_apart_across_rows():
    import pyarrow as pa

    texts = ["a b", "", "ab", None, "B  c\td", "b"]
    for _, _, data, at in words.pieces(pa.array(texts)):
        h, row, starts, ends = words.hashed(data, at, words.SPACED)
    assert row.tolist() == [0, 0, 2, 4, 4, 4, 5]
    assert h[1] == h[3] == h[6] and len(set(h.tolist())) == 5


def test_token_histogram(spark, docs, empty, rows):
    import base64

    import public_tokenizers as P
    import tiktoken

    raw = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = np.array([len(own.encode_ordinary(t or "")) for _, t in rows])
    found = token_counts.token_histogram(docs, raw, P.PATTERN)
    got = {r.n_tokens: r for r in found.collect()}
    assert set(got) == set(n.tolist())
    for limit, r in got.items():
        assert (r.docs, r.docs_to, r.docs_above) == ((n == limit).sum(), (n <= limit).sum(), (n > limit).sum())
        assert (r.tokens_to, r.tokens_above, r.truncated_tokens) == (n[n <= limit].sum(), n[n > limit].sum(), np.minimum(n, limit).sum())
    for limit, r in token_counts.at_limits(found, [0, 3, 100, 10**6]).items():
        assert r == {"docs_to": (n <= limit).sum(), "docs_above": (n > limit).sum(), "truncated_tokens": np.minimum(n, limit).sum()}
    assert token_counts.quantiles(found, [0.5, 1.0]) == [np.sort(n)[math.ceil(len(n) / 2) - 1], n.max()]
    assert token_counts.token_histogram(empty, raw, P.PATTERN).count() == 0


def test_long_texts_encode_in_parts_as_in_one():
    text = prose(40000) + "'s  tail 12 x"
    cut = list(token_counts.parts(text, 1000))
    assert len(cut) > 10 and "".join(cut) == text and all(p[0] == " " for p in cut[1:])


def test_quality(spark, docs, empty, rows):
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in (1, 2, 3, 9, 10, 14, 15, 21)] + [(11, 0, 0), (12, 0, 0), (13, 0, 0), (4, None, 1), (None, 0, 0), (1, 1, 1)],
        "doc_id long, quality int, score int",
    )
    found = quality.classify(docs, labels).select("row.doc_id", "held_out", "score", "predicted").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    again = quality.classify(docs.repartition(2), labels).select("row.doc_id", "score").collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in found) == sorted((str(r.doc_id), round(r.score, 6)) for r in again)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.where("false")).select("score").collect()} == {0.5}


def test_quality_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.FEATURES)).astype(np.float32)
    bags = np.arange(0, 401, 4)
    label = (x.reshape(100, 4, -1)[:, :, 3].max(1) > 1).astype(float)
    score, _ = quality.attend(quality.fit(x, bags, label), x, bags)
    assert ((score > 0.5) == label).mean() > 0.95


def test_quality_slopes_equal_numeric_ones():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 9))
    at = np.array([0, 1, 8, 8 + 15, 30])
    label = np.array([1.0, 0.0, 1.0, 0.0])
    model = quality.first_model(x.mean(0), x.std(0), 2, 4)
    model = {k: v + rng.normal(0, 0.2, np.shape(v)) if k in quality.LEARNED else v for k, v in model.items()}

    def loss(m):
        total = 0.0
        for i in range(4):  # bag by bag, passage by passage
            e, hs = [], []
            for u in (x[at[i] : at[i + 1]] - m["mean"]) / m["scale"]:
                h = np.tanh(u @ m["W"] + m["b"])
                e.append(math.exp((np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"])))) @ m["w"]))
                hs.append(h)
            z = sum(a * h for a, h in zip(e, hs)) / sum(e)
            p = 1 / (1 + math.exp(-(z @ m["c"] + m["d"])))
            total -= math.log(p if label[i] else 1 - p)
        return total / 4

    got = quality.slopes(model, x, at, label)
    for k in quality.LEARNED:
        for _ in range(5):
            place = tuple(rng.integers(0, n) for n in np.shape(model[k]))
            near = {n: np.array(v, float) for n, v in model.items()}
            near[k][place] += 1e-5
            up = loss(near)
            near[k][place] -= 2e-5
            assert abs((up - loss(near)) / 2e-5 - np.asarray(got[k])[place]) < 1e-6, k


def test_quality_learns_from_every_passage(spark):
    """Long texts that differ by one bad passage, far from any even spacing of a few."""
    rng = random.Random(9)
    good = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + ". "
    rows = []
    for i in range(160):
        parts = [good(160) for _ in range(rng.randint(70, 100))]
        if i % 2:
            parts[rng.randrange(len(parts))] = "$$ BUY ## NOW !! 0000 " * 60
        rows.append((i, "".join(parts), 1 - i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    found = quality.classify(docs, labels).select("row.doc_id", "held_out", "predicted").collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 30 and sum(r.predicted == 1 - r.doc_id % 2 for r in held) >= 0.95 * len(held)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[100:400] = v[100]
    v[401] = v[400] * 2
    data = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    data += [(1000, None, 1), (1050, [0.0] * 8, 1), (1100, [float("nan")] + [1.0] * 7, 1), (1150, [None] + [1.0] * 7, 1),
             (1200, [1.0] * 3, 1), (None, v[0].tolist(), 1), (50, v[50].tolist(), 1), (1250, [float("inf")] * 8, 1), (1300, [], 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int").repartition(5)
    got = {}
    for r in neighbours.nearest(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 50))
    d = v.astype(np.float64)
    norm = np.sqrt((d * d).sum(1))
    hits = 0
    for q, found in got.items():
        sims = (d * d[q]).sum(1) / (norm * norm[q])
        sims[q] = -2
        want = np.lexsort((np.arange(700), -sims))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(sims[i] - s) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(want.tolist()))
    assert hits >= 0.9 * 5 * len(got)
    assert [f[1] for f in got[300]] == [100, 101, 102, 103, 104]
    assert neighbours.nearest(table.where("false")).count() == 0
    few = neighbours.nearest(table.where("vec_id in (0, 1, 2)")).collect()
    assert len(few) == 2


def test_neighbours_among_scaled_and_shifted_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    v = [base * 2.0 ** rng.integers(-20, 20) for _ in range(150)]
    v += [base * s for s in rng.uniform(0.1, 9, 150)]
    v += [base + 1e-9 * rng.normal(size=8) for _ in range(300)] + list(rng.normal(size=(100, 8)))
    v = np.array(v)[rng.permutation(700)]
    # One id has many vectors, all of them nearest.
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(1, (base * s).tolist()) for s in range(1, 40)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in neighbours.nearest(table).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    near = [q for q in range(0, 700, 50) if neighbours.cosine(v[q][None], base[None])[0] > 0.999]
    assert len(near) > 5
    every = np.array([x for _, x in data])
    for q in near:
        best = {}
        for (i, _), score in zip(data, neighbours.cosine(np.repeat(v[q][None], len(every), 0), every)):
            if i != q:
                best[i] = max(best.get(i, -2), score)
        assert got[q] == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]


@pytest.mark.parametrize("block, asked", [(30, 20_000), (20_000, 3), (30, 2)])
def test_lists_beyond_a_block_are_split(spark, monkeypatch, block, asked):
    v = np.random.default_rng(2).normal(size=(300, 6)).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, neighbours.nearest(table, every=5).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "ASKED", asked)
    assert neighbours.nearest(table).count() == 30
    assert sorted(map(tuple, neighbours.nearest(table, every=5).collect())) == want


def test_recall_on_many_lists(spark):
    """Far more lists than are read for a query: clustered and even vectors."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(300, 24))
    v = np.concatenate([centres[rng.integers(300, size=12000)] + 0.3 * rng.normal(size=(12000, 24)), rng.normal(size=(8000, 24))])
    v = v[rng.permutation(len(v))].astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(8)
    got = {}
    for r in neighbours.nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = neighbours.unit(v)
    hits = 0
    for q in range(0, len(v), 50):
        sims = u @ u[q]
        sims[q] = -2
        hits += len(got[q] & set(np.argpartition(-sims, 5)[:5].tolist()))
    assert hits >= 0.95 * 5 * len(got) and len(got) == 400


def test_mixing(spark, docs, empty, rows):
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(rows)
    assert sorted(r.size for r in found) == sorted(len(brute.spaced(t)) for _, t in rows)
    total = sum(r.size for r in found)
    targets = {r.source: (r.target, r.source_size) for r in found}
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * s for t, s in targets.values())
    assert all(r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in found)
    assert sum(r.taken for r in found) <= 1.5 * total
    assert mixing.mix_sources(empty).count() == 0
    assert {r.taken for r in mixing.mix_sources(docs.where("doc_id = 5")).collect()} == {0}


def test_mixing_twin_on_messy_rows(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want = sorted(map(str, con.sql(mixing.ORACLE_SQL).select("doc_id, source, size, source_size, taken").fetchall()))
    got = mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "taken").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_word_count_matches_the_pattern(spark):
    texts = ["", " ", "a", " a", "a ", "  a\tb \n", None, "a\x0bb\x0cc", "a b c", "\x00 \x1f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n"))
    assert {(r.t, r.n) for r in df.collect()} == {(t, len(brute.spaced(t))) for t in texts}


def test_transcripts(spark):
    raw = [
        (1, "System: be kind\n\nUser: hi there?\nmore of it\n\nAssistant: hello\n\nfine\n\nUser: bye"),
        (2, None), (3, ""), (4, "\n \n"), (5, "no marker at all"), (5, "no marker at all"), (None, "### Instruction\nadd\n### Response\n2"),
        (6, "Q: " + "word " * 5000 + "\nA: ok"),
    ]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in raw], "conv_id long, text string, roles string, turns int")
    found = transcripts.parse(table, transcripts.Model.prior()).collect()
    assert len(found) == len(raw)
    roles = {r.conv_id: [t.role for t in r.turns] for r in found}
    assert roles[1] == ["system", "user", "assistant", "user"]
    assert roles[2] == roles[3] == roles[4] == []
    assert roles[None] == roles[6] == ["user", "assistant"] and roles[5] == ["user"]
    one = next(r for r in found if r.conv_id == 1)
    assert one.rendered.startswith("<|system|>\nbe kind\n<|end|>\n<|user|>\nhi there?\nmore of it\n<|end|>\n<|assistant|>\nhello\nfine")
    assert transcripts.parse(table.where("false"), transcripts.Model.prior()).count() == 0


def test_viterbi_finds_the_best_path():
    import itertools

    model = transcripts.Model.prior()
    rng = np.random.default_rng(3)
    for _ in range(5):
        seen = [(int(rng.integers(transcripts.MARKS)), int(rng.integers(16))) for _ in range(4)]

        def value(path):
            total = model.start[path[0]]
            for i, s in enumerate(path):
                total += model.marks[s, seen[i][0]] + model.features[s, seen[i][1]]
                total += model.move[path[i - 1], s] if i else 0
            return total

        best = max(value(p) for p in itertools.product(range(transcripts.STATES), repeat=4))
        assert abs(value(model.path(seen)) - best) < 1e-9


def test_transcript_roles_are_recovered(spark):
    turns = []
    for c in range(60):
        for t in range(RNG.randint(2, 7)):
            turns.append((c, t, "assistant" if t % 2 else "user", prose(RNG.randint(2, 30)).replace(" w7", "\nw7")))
    turns += [(1, None, "user", "x"), (None, 1, "user", "x"), (2, 0, None, "x"), (3, 0, "tool", "x"), turns[0]]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    raw = transcripts.raw_transcripts(table).cache()
    found = transcripts.parse(raw, transcripts.fit(raw)).collect()
    want = {}
    for c, t, role, _ in turns:
        if c is not None and t is not None and role in ("user", "assistant"):
            want.setdefault(c, {})[t] = role
    right = sum([t.role for t in r.turns] == [v for _, v in sorted(want[r.conv_id].items())] for r in found)
    assert len(found) == 60 and right >= 57


def test_transcripts_keep_turns_of_other_roles(spark):
    turns = [
        (1, 0, "user", "which one?"), (1, 1, "tool", "looked up\nfour rows"), (1, 2, "assistant", "that one"),
        (2, 0, "function", "only this"), (3, 0, None, "no role"), (4, None, "user", "no order"), (4, 0, "assistant", "first"),
        (5, 0, "tool", None), (None, 0, "user", "of no conversation"),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    raw = transcripts.raw_transcripts(table).cache()
    known = {r.conv_id: [x.role for x in r.roles] for r in raw.collect()}
    assert known[1] == ["user"] * (len(known[1]) - 3) + [None, None, "assistant"]
    assert known[2] == known[3] == [None] and known[5] == []
    found = {r.conv_id: r for r in transcripts.parse(raw, transcripts.fit(raw)).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]
    for conv, _, _, text in turns:
        for line in (text or "").split("\n"):
            assert conv is None or line in found[conv].rendered
    assert found[4].rendered.index("first") < found[4].rendered.index("no order")


def test_transcript_moves_stop_at_unknown_roles(spark):
    line = lambda role, first=True: {"role": role, "first": first}
    table = spark.createDataFrame(
        [("User: a\nb\nBot: c\nBot: d", [line("user"), line(None), line("assistant"), line("assistant")])] * 1000,
        "text string, roles array<struct<role:string,first:boolean>>",
    )
    model = transcripts.fit(table)
    # All texts start with the user; the one known move is from an assistant to another.
    assert model.start.argmax() == 2 and model.start[4] < -2 and model.move[4].argmax() == 4


def test_phrases(spark, docs, empty, rows):
    long = rows[16][1].split()
    items = [(1, " ".join(long[5000:5030])), (2, "one"), (3, None), (4, ""), (None, rows[0][1][:200]), (1, " ".join(long[9000:9012])),
             (5, " ".join(long[5005:5020])), (5, " ".join(long[5005:5020]))]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, key int, place string")
    want = sorted(str((d, n, h, sorted(map(str, f)))) for d, n, h, f in brute.phrases(rows, items))
    for block in (phrases.BLOCK, 7):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(phrases, "BLOCK", block)
            got = phrases.find_phrases(docs, table).collect()
        assert sorted(str((r.doc_id, r.n_words, r.n_hit, sorted(map(str, r["items"])))) for r in got) == want
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(phrases, "SEGMENT", 3000)
        got = phrases.find_phrases(docs, table).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, sorted(map(str, r["items"])))) for r in got) == want
    assert phrases.find_phrases(empty, table).count() == 0
    assert {r.n_hit for r in phrases.find_phrases(docs, table.where("false")).collect()} == {0}
    kept = phrases.decontaminate(docs, table)
    assert kept.columns == docs.columns
    clean = [d for d, _, h, _ in brute.phrases(rows, items) if not h]
    assert sorted(map(str, clean)) == sorted(str(r.doc_id) for r in kept.collect())


def test_phrases_in_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a x b c y d e"), (3, "a b"), (4, "c d e")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c d e")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near) for r in phrases.find_phrases(docs, items, size=5, slop=2).collect()}
    assert got == {1: ([9], []), 2: ([], [9]), 3: ([], []), 4: ([], [])}


@pytest.mark.parametrize("segment", [phrases.SEGMENT, 400])
def test_proximity_equals_all_alignments(spark, monkeypatch, segment):
    monkeypatch.setattr(phrases, "SEGMENT", segment)
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 4, 5, 7])))) for i in range(25)]
    texts = []
    for _ in range(120):
        w = [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        own = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):  # moved, lost and added words
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = [rng.choice("abxyz")] * rng.randrange(3)
            own = own or ["a"]
        texts.append(" ".join(w + own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute.near_phrases(list(enumerate(texts)), items, 5, 2)
    got = {r.doc_id: (set(r["items"]), set(r.near)) for r in phrases.find_phrases(docs, table, size=5, slop=2).collect()}
    assert got == want and sum(len(n) for _, n in want.values()) > 50


def test_repeats(spark, docs, empty, rows):
    want = brute.repeats([t for _, t in rows], 256)
    got = repeats.find_repeats(docs, length=256).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted(str((i, *w)) for (i, _), w in zip(rows, want)) == sorted(
        str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got
    )
    out = repeats.remove_repeats(docs, length=256)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert repeats.find_repeats(empty).count() == 0


def test_parts_of_cut_characters_go(spark):
    long = prose(200)
    texts = [f"one \ufffd {long}\u00fc wort", f"two {long}\u00f6 wort", "three \u00fc \ufffd"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [k for _, _, _, k in brute.repeats(texts, 400)]
    assert any(b"\xbc wort" in k and b"\xc3\xbc" not in k for k in want)
    got = {r.doc_id: r.text for r in repeats.remove_repeats(table).collect()}
    assert got == {i: k.decode("utf-8", "ignore") for i, k in enumerate(want)}
    assert [got[i].count("\ufffd") for i in range(3)] == [1, 0, 1]
    lost = table.select("doc_id", F.when(F.col("doc_id") == 0, F.concat(F.unhex(F.lit("BC20")), F.encode("text", "utf-8"))).otherwise(F.encode("text", "utf-8")).cast("string").alias("text"))
    got = {r.doc_id: r.text for r in repeats.remove_repeats(lost).collect()}
    assert [got[i].count("\ufffd") for i in range(3)] == [2, 0, 1]


@pytest.mark.parametrize("crowd", [repeats.CROWD, 2])
def test_repeats_random_edits(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(8)
    base = prose(900, rng)
    texts = []
    for _ in range(40):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(["ü", "edit", ""])
        lo = rng.randrange(400)
        texts.append(" ".join(w[lo : lo + rng.randint(50, 500)]))
    texts += ["é" * 400, "z" + "é" * 500, ("abcdefg" * 200)[3:], "abcdefg" * 90 + "!"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.find_repeats(table).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == brute.repeats(texts, 400)


def test_licenses(spark, docs, empty, rows):
    texts = [
        (1, "prose here\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License,\nVersion 2.0."),
        (3, "licensed UNDER cc by-nc 4.0"), (4, "the license of the work"), (5, None), (6, ""), (7, "Released under the MIT License."),
        (7, "Released under the MIT License."), (8, "\n".join(["x y z"] * 3000) + "\nThis work is licensed under the GNU General Public License, version 3."),
    ]
    table = spark.createDataFrame([(i, t, 1.0) for i, t in texts], "doc_id long, text string, licenses double")
    got = sorted((r.doc_id, [x.name for x in r.licenses]) for r in licenses.scan_licenses(table).collect())
    assert got == [(1, ["MIT"]), (2, ["Apache-2.0"]), (3, ["CC-BY-NC-4.0"]), (4, []), (5, []), (6, []), (7, ["MIT"]), (7, ["MIT"]), (8, ["GPL-3.0"])]
    assert licenses.scan_licenses(docs).where("size(licenses) > 0").count() == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_inside_prose_and_over_many_lines(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][1]
    far = "Permission is hereby granted, " + "free " * 5000 + licenses.TEMPLATES["MIT"][1].split("granted, ")[1]
    texts = [
        f"all four words before {mit[:-1]} and many more words on the same line", "\n\n".join(gpl.split()), "intro\n" + gpl.replace(" ", "\n") + " end",
        "a b " + licenses.TEMPLATES["GPL-3.0"][0] + " c " + licenses.TEMPLATES["CC0-1.0"][0] + " d", far,
        f"{licenses.TEMPLATES['GPL-3.0'][0]} x {licenses.TEMPLATES['GPL-2.0'][0].replace('This work', 'It')}",
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.licenses] for r in licenses.scan_licenses(table).collect()}
    assert got[0] == [("MIT", 1.0, 0, 1)]
    words_of = len(gpl.replace(",", " ").split())
    assert got[1] == [("GPL-3.0", 1.0, 0, 2 * words_of - 1)]
    assert got[2] == [("GPL-3.0", 1.0, 1, words_of)]
    assert got[3] == [("CC0-1.0", 1.0, 0, 1), ("GPL-3.0", 1.0, 0, 1)]
    assert [x[0] for x in got[4]] == ["MIT"] and got[4][0][1] > 0.95
    assert [x[0] for x in got[5]] == ["GPL-2.0", "GPL-3.0"]
    one = licenses.scan_licenses(table.limit(1), templates={"A": ["MORE"], "B": [""], "C": ["no such words"]}).first()
    assert [tuple(x) for x in one.licenses] == [("A", 1.0, 0, 1)]


def test_whole_licence_texts_are_found(spark):
    whole = {name: texts[-1] for name, texts in licenses.all_templates().items()}
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0"]
    rows, want = [], {}
    for i, name in enumerate(names):
        text = whole[name]
        rows.append((i, f"{prose(80)}\n{text}\n{prose(50)}"))
        rows.append((100 + i, "Copyright (c) 2020 someone\n" + " ".join(text.replace("University", "project").upper().split())))
        # One word in forty is another one.
        rows.append((200 + i, " ".join(RNG.choice(WORDS) if k % 40 == 7 else w for k, w in enumerate(text.split()))))
        want |= {i: [name], 100 + i: [name], 200 + i: [name]}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(table).collect()}
    assert {i: [x.name for x in found] for i, found in got.items()} == want
    # A passage starts with a bigram that it holds once, so it may start some lines later.
    assert [got[i][0].score for i in range(len(names))] == [1] * len(names)
    assert [got[i][0].line for i in range(3)] == [1, 1, 1] and all(1 <= got[i][0].line < 20 for i in range(len(names)))
    half = spark.createDataFrame([(1, whole["MIT"][: len(whole["MIT"]) // 3])], "doc_id long, text string")
    assert [x.score for x in licenses.scan_licenses(half, templates={"MIT": [whole["MIT"]]}).first().licenses] == []


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("B", "two words here"), ("A", "one more text"), ("A", "a b c"), (None, "x"), ("C", None), ("A", "a b c")], "name string, text string")
    assert licenses.templates_of(table) == {"A": ["a b c", "one more text"], "B": ["two words here"]}
    with pytest.raises(ValueError):
        licenses.templates_of(table, most=2)


def test_license_passages_equal_all_windows(spark):
    rng = random.Random(8)
    notice = "a b c d e f g"
    texts = [" ".join(rng.choice("abcdefgxy") if rng.random() < 0.4 else "abcdefg"[i % 7] for i in range(rng.randint(1, 40))) for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = lambda w: set(zip(w, w[1:]))
    own, hits = pairs(notice.split()), 0
    for r in licenses.scan_licenses(table, templates={"N": [notice]}, threshold=0.7).collect():
        w = texts[r.doc_id].split()
        windows = (pairs(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1))
        best = max((2 * len(own & x) / (len(own) + len(x)) for x in windows), default=0)
        assert [x["score"] for x in r.licenses] == ([best] if best >= 0.7 else [])
        hits += best >= 0.7
    assert 20 < hits < 280


def test_bilinear(spark, docs, empty, rows):
    got = bilinear.score_texts(docs).collect()
    tokens = [(i, brute.spaced(t) + [None]) for i, t in rows]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows}
    count = {}
    for i, w in tokens:
        for x in w if not held[i] else ():
            count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(i), held[i], len(w), sum(x in count for x in w), n, round(sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6))
        for i, w in tokens
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert bilinear.score_texts(empty).count() == 0
    assert bilinear.score_texts(docs.where("doc_id = 2")).count() == 1


def test_bilinear_head_and_rare_words_agree(spark, docs):
    scores = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in bilinear.score_texts(docs).collect())
    whole = scores()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bilinear, "HEAD", 5)
        assert scores() == whole


def random_model(word_symbols, seed=0):
    shape = bilinear.Shape(word_symbols)
    rng = np.random.default_rng(seed)
    model = bilinear.first_model(shape, rng.poisson(3, shape.symbols).astype(float))
    return shape, {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) if k in bilinear.LEARNED else v for k, v in model.items()}


def plain_log(model, shape, before, symbol):
    """log10 P(symbol | the list of symbols before it), one sum after the other."""
    q = []
    for d in range(bilinear.DIMENSIONS):
        near = [float(model["context"][before[-j] if j <= len(before) else shape.end][d]) for j in (1, 2)]
        far = sum(float(model["context"][c][d]) for c in before[:-2][-bilinear.FAR :]) / bilinear.FAR
        q.append(sum(x * float(w[d]) for x, w in zip([*near, far], model["weight"])))
    dot = lambda row: sum(a * float(b) for a, b in zip(q, row))
    g, m = symbol % shape.groups, symbol // shape.groups
    groups = [dot(model["group"][i]) + float(model["group_bias"][i]) for i in range(shape.groups)]
    members = [dot(model["member"][s]) + float(model["member_bias"][s]) for s in range(g, shape.symbols, shape.groups)]
    log_sum = lambda x: math.log(sum(map(math.exp, x)))
    return (groups[g] - log_sum(groups) + members[m] - log_sum(members)) / math.log(10)


@pytest.mark.parametrize("word_symbols", [0, 1, 40, 700])
def test_bilinear_chances_sum_to_one_and_equal_plain_sums(word_symbols):
    shape, model = random_model(word_symbols)
    every = np.arange(shape.symbols)
    assert sum(shape.members(g) for g in range(shape.groups)) == shape.symbols
    past = np.random.default_rng(1).integers(0, shape.symbols, 20)
    logs = [bilinear.log_chances(model, shape, np.append(past, s), np.arange(21))[-1] for s in every]
    assert abs(sum(10.0**x for x in logs) - 1) < 1e-4
    for s in every[:: max(1, len(every) // 9)]:
        assert abs(logs[s] - plain_log(model, shape, past.tolist(), int(s))) < 1e-4
    # Several texts at once, and a long one in parts, give the same sums.
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, shape.symbols, n) for n in (1, 3, 30, 200)]
    share = rng.normal(size=shape.symbols)
    want = [sum(plain_log(model, shape, t[:i].tolist(), int(t[i])) - share[t[i]] for i in range(len(t))) for t in texts]
    assert np.allclose(bilinear._texts_log(model, shape, share, texts), want, atol=0.01)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bilinear, "TOGETHER", 16)
        assert np.allclose([bilinear._texts_log(model, shape, share, [t])[0] for t in texts], want, atol=0.01)


def test_bilinear_slopes_equal_numeric_ones():
    shape, model = random_model(20)
    model = {k: v.astype(np.float64) for k, v in model.items()}
    rng = np.random.default_rng(3)
    symbol = rng.integers(0, shape.symbols, 80)
    place = np.concatenate([np.arange(25), np.arange(1), np.arange(2), np.arange(52)])

    def loss(m):
        q = np.zeros((len(symbol), bilinear.DIMENSIONS))
        for i, p in enumerate(place):
            for j in (1, 2):
                q[i] += m["context"][symbol[i - j] if j <= p else shape.end] * m["weight"][j - 1]
            for j in range(3, 3 + bilinear.FAR):
                if j <= p:
                    q[i] += m["context"][symbol[i - j]] * m["weight"][2] / bilinear.FAR
        total = 0.0
        group, member = shape.place(symbol)
        for i in range(len(symbol)):
            own = slice(group[i], None, shape.groups)
            for vectors, bias, noise, target in (
                (m["group"], m["group_bias"], m["group_noise"], group[i]),
                (m["member"][own], m["member_bias"][own], m["member_noise"][own], member[i]),
            ):
                x = vectors @ q[i] + bias - noise
                total += np.log1p(np.exp(-x[target])) + (np.exp(noise) * np.log1p(np.exp(x))).sum()
        return total / len(symbol)

    got = bilinear.slopes({k: v.astype(np.float32) for k, v in model.items()}, shape, symbol, place)
    for k in bilinear.LEARNED:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in model[k].shape)
            if k == "context":
                at = (int(rng.choice(np.append(symbol, shape.end))), at[1])
            near = {x: v.copy() for x, v in model.items()}
            near[k][at] += 1e-4
            up = loss(near)
            near[k][at] -= 2e-4
            assert abs((up - loss(near)) / 2e-4 - got[k][at]) < 2e-3, (k, at)


def test_bilinear_scores_equal_plain_sums(spark, monkeypatch):
    """The whole score against loops over the tokens, with a model that is given."""
    rng = random.Random(3)
    texts = [(i, prose(rng.randint(0, 60), rng)) for i in range(40)] + [(100, None), (101, "unseen words only"), (102, "unseen W1 \n end")]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    given = {}

    def fixed(streams, shape, counts):
        given["shape"], given["model"] = shape, random_model(shape.end, 9)[1]
        return given["model"]

    monkeypatch.setattr(bilinear, "train", fixed)
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in bilinear.score_texts(table).collect()}
    shape, model = given["shape"], given["model"]
    count = {}
    for i, t in texts:
        for w in brute.spaced(t) if not held(i) else ():
            count[w] = count.get(w, 0) + 1
    import pyarrow as pa

    def facts(word):
        for _, _, data, at in words.pieces(pa.array([word])):
            h, _, starts, ends = words.hashed(data, at, words.SPACED)
            return int(h[0]), int(bilinear._classes(words.LOWER[data], starts, ends)[0])

    by_hash = sorted(count, key=lambda w: facts(w)[0])
    top = sorted(by_hash, key=lambda w: -count[w])[: shape.end]
    assert shape.end == math.isqrt(len(count))
    rest = [w for w in count if w not in top]
    for i, t in texts:
        total, seen = 0.0, []
        for w in brute.spaced(t) + [None]:
            if w is None:
                s = shape.end
            elif w in top:
                s = top.index(w)
            else:
                c = facts(w)[1]
                s = shape.end + 1 + c
                own = [x for x in rest if facts(x)[1] == c]
                total += math.log10((count.get(w, 0) + 0.5) / (sum(count[x] for x in own) + 0.5 * (len(own) + 1)))
            total += plain_log(model, shape, seen, s)
            seen.append(s)
        assert abs(total - got[i]) < 0.01, i


def test_near_duplicates(spark, docs, empty, rows):
    got = minhash.near_duplicates(docs).collect()
    want = sorted(map(str, brute.near(rows)))
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and 20 not in ids and ids.count(5) == 2 and ids.count(15) == 2
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [minhash.BLOCK, 700])
def test_near_duplicates_in_chains_and_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    texts, base = [], prose(60, rng).split()
    for i in range(80):  # a chain: neighbours are alike, ends are not
        base[rng.randrange(60)] = f"step{i}"
        texts.append(" ".join(base))
    shared = prose(40, rng)
    texts += [shared + " " + prose(rng.randint(5, 60), rng) for _ in range(80)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(table).collect())
    assert got == brute.near(list(enumerate(texts)))
