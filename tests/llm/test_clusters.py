"""Centroid clusters against plain Python, on messy vectors."""

import hashlib
import math

import numpy as np
import pytest

from gridwash.llm import clusters


def plain(data, k, rounds, dims, scale=64, seed=1):
    whole = lambda v: [math.floor(scale * float(x)) for x in v]
    given = [(i, v) for i, v in data if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, whole(v)) for i, v in given]
    name = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    first = sorted(given, key=lambda r: (name(r[0]), r[1]))[:k]
    centroids = [whole(v) for _, v in first]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(v):
        return min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c))

    for _ in range(rounds):
        own = [[v for _, v in kept if nearest(v) == c] for c in range(len(centroids))] if kept else []
        centroids = [[sum(col) // len(vs) for col in zip(*vs)] if vs else c for vs, c in zip(own, centroids)]
    placed = [(i, nearest(v), away(v, centroids[nearest(v)])) for i, v in kept]
    total = {}
    for _, c, d in placed:
        total[c] = total.get(c, 0) + d
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return [(i, c, d, total[c], sum(total.values()), sha(c)) for i, c, d in placed]


def rows_of(frame):
    return sorted(str(tuple(r)) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


SCHEMA = "vec_id long, embedding array<{}>, cluster int, place string, n int, hash string"


def frame(spark, data, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x", 2, "h") for i, v in data], SCHEMA.format(kind)).repartition(4)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6)).astype(np.float32)
    v[50:150] = v[50]  # a hot copy
    v[150:200] = np.round(v[150:200])  # many ties
    out = [(i, x.tolist()) for i, x in enumerate(v)]
    return out + [
        (400, None), (401, []), (402, [1.0] * 5), (403, [1.0] * 5 + [None]), (404, [float("nan")] + [0.0] * 5),
        (405, [float("-inf")] + [0.0] * 5), (406, [-0.0] * 6), (None, [0.5] * 6), (7, v[9].tolist()), (8, v[8].tolist()),
    ]


@pytest.mark.parametrize("k", [1, 5, 16])
def test_clusters_equal_plain(spark, data, k):
    got = clusters.cluster(frame(spark, data), k=k, dims=6)
    assert rows_of(got) == sorted(map(str, plain(data, k, 3, 6)))


def test_few_or_no_vectors(spark, data):
    some = data[:3] + [(2, data[0][1]), (None, [1.0] * 6)]
    assert rows_of(clusters.cluster(frame(spark, some), dims=6)) == sorted(map(str, plain(some, 16, 3, 6)))
    assert clusters.cluster(frame(spark, data).where("false"), dims=6).collect() == []
    assert clusters.cluster(frame(spark, data), dims=64).collect() == []
    assert rows_of(clusters.cluster(frame(spark, data), dims=6, k=4, rounds=0)) == sorted(map(str, plain(data, 4, 0, 6)))


def test_components_beyond_64_bits_stay_exact(spark):
    rng = np.random.default_rng(5)
    wide = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(120)]
    got = clusters.cluster(frame(spark, wide, "double"), k=5, dims=4).collect()
    want = {r[0]: r for r in plain(wide, 5, 3, 4)}
    fits = lambda d: d if d < 1 << 63 else None
    assert len(got) == 120
    for r in got:
        i, c, d, _, _, name = want[r.vec_id]
        assert (r.cluster, r.distance, r.centroid_sha256) == (c, fits(d), name)
    with pytest.raises(Exception, match="below 1e26"):
        clusters.cluster(frame(spark, [(1, [1e30, 0.0])], "double"), dims=2).collect()


def test_zero_on_the_bisector_favours_the_smaller_number():
    one = clusters.Bisectors([[0, 0], [4, 0], [0, 0], [-4, 0]])
    x = np.array([[2, 9], [-2, 3], [0, 1], [3, 0], [-3, 0]])
    assert one.nearest(x).tolist() == [0, 0, 0, 1, 3]
    assert one.distance(x, one.nearest(x)).tolist() == [85, 13, 1, 1, 1]
