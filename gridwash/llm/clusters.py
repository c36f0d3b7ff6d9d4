"""Centroid clustering in whole numbers, assigned by a tournament of bisectors.

For centroids a < b the plane halfway between them tells which is nearer to x:

    |x - a|^2 <= |x - b|^2   exactly when   x . 2(b - a) <= |b|^2 - |a|^2

The normals 2(b - a) and thresholds of all pairs are made once a round. A vector starts
with centroid 0; each next centroid challenges the one that stands, so k - 1 sign tests
leave the nearest. Equality keeps the smaller number, since the one that stands is
always smaller. Only the winner's distance is computed. All of it is exact.

The vectors are read from the given table in every round and never shuffled: a task
leaves one row of sums per centroid and place. Only centroids reach the driver.
"""

from __future__ import annotations

import decimal
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridwash.functions.cells import column
from gridwash.llm.tables import stored

#: Sums are decimals of 38 digits; a component from here on is refused.
WIDEST = 10**26


def narrow(dims: int) -> int:
    """Whole numbers below this magnitude keep every test and distance within 64 bits."""
    return math.isqrt((1 << 60) // max(1, dims))


def whole(lists: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, floor(scale * x) of their components) of a list column."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(size == dims)
    flat = lists.take(pa.array(right)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null becomes NaN
    finite = np.isfinite(x).all(1)
    kept = np.zeros(len(size), bool)
    kept[right[finite]] = True
    x = np.floor(scale * x[finite])
    if not x.size or np.abs(x).max() < narrow(dims):
        return kept, x.astype(np.int64)
    if not (np.abs(x) < WIDEST).all():
        raise ValueError(f"components times {scale} must be below 1e26")
    return kept, np.array([[int(v) for v in row] for row in x], object).reshape(-1, dims)


class Bisectors:
    """Normals and thresholds of all pairs of centroids, k * k * dims numbers."""

    def __init__(self, centroids: list[list[int]]):
        small = max((abs(v) for c in centroids for v in c), default=0) < narrow(len(centroids[0]) if centroids else 0)
        self.centroids = np.array(centroids, np.int64 if small else object)
        if not centroids:
            return
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        square = (self.centroids * self.centroids).sum(1)
        self.thresholds = square[None, :] - square[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row, ties to the smaller number."""
        stands = np.zeros(len(x), np.int64)
        for rival in range(1, len(self.centroids)):
            side = (x * self.normals[stands, rival]).sum(1)
            stands[side > self.thresholds[stands, rival]] = rival
        return stands

    def distance(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Squared distance to the given centroid of each row."""
        apart = x - self.centroids[number]
        return (apart * apart).sum(1)


def _sums(vectors: DataFrame, bisectors, dims: int, scale: int) -> dict[int, tuple[int, dict[int, int]]]:
    """{cluster: (vectors, {place: sum})}: what the next centroids are made of."""

    def add(batches):
        count, total = {}, {}
        for batch in batches:
            _, x = whole(batch.column(0), dims, scale)
            number = bisectors.value.nearest(x)
            for c in np.unique(number).tolist():
                own = x[number == c]
                count[c] = count.get(c, 0) + len(own)
                # 64 bits hold the sum of a batch, Python's numbers that of a task.
                total[c] = total.get(c, 0) + own.sum(0).astype(object)
        rows = [(c, i, count[c], decimal.Decimal(int(v))) for c in total for i, v in enumerate(total[c])]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["cluster", "place", "n", "total"]
        )

    parts = vectors.mapInArrow(add, "cluster int, place int, n long, total decimal(38,0)")
    out: dict[int, tuple[int, dict[int, int]]] = {}
    # One row per centroid and place, whatever the table holds.
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out.setdefault(r["cluster"], (r["n"], {}))[1][r["place"]] = int(r["total"])
    return out


def first_centroids(vectors: DataFrame, id_col: str, vector_col: str, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` kept vectors with smallest sha256 of ``seed:id``, in that order."""

    def keep(batches):
        for batch in batches:
            kept, _ = whole(batch.column(1), dims, scale)
            yield batch.filter(pa.array(kept))

    named = F.sha2(F.concat(F.lit(f"{seed}:"), column(id_col).cast("string")), 256)
    rows = vectors.select(named.alias("hash"), column(vector_col).cast("array<double>").alias("vector"))
    # Every task keeps the first k rows.
    first = rows.mapInArrow(keep, rows.schema).orderBy(F.asc_nulls_last("hash"), "vector").limit(k).collect()
    return [[math.floor(scale * x) for x in r["vector"]] for r in first]


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    seed: int = 1,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors of exactly ``dims`` components, none of them null, NaN or infinite;
    a component x counts as floor(scale * x). The first centroids are the ``k`` vectors
    whose sha256 of ``seed:id`` is smallest (ids that are null come last, equal ids by
    their components); each round assigns all vectors and moves every centroid
    that has some to the floor of their mean. Distances are squared.

    Repeated rows and ids count each; with fewer than ``k`` vectors there are as many
    centroids; none give no rows. Distances and inertias beyond 64 bits are null, and
    components from 1e26 on (after scaling) raise an error. Other columns are ignored.
    Tasks hold k * k * dims numbers, so ``k`` should stay within some hundreds.
    """
    context = vectors.sparkSession.sparkContext
    given = vectors.select(column(vector_col).alias("vector"))
    centroids = first_centroids(vectors, id_col, vector_col, k, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        for c, (n, sums) in _sums(given, context.broadcast(Bisectors(centroids)), dims, scale).items():
            centroids[c] = [sums[place] // n for place in range(dims)]
    bisectors = context.broadcast(Bisectors(centroids))

    def assign(batches):
        for batch in batches:
            kept, x = whole(batch.column(1), dims, scale)
            number = bisectors.value.nearest(x) if len(x) else np.zeros(0, np.int64)
            distance = bisectors.value.distance(x, number) if len(x) else number
            fits = pa.array([int(d) if d < 1 << 63 else None for d in distance], pa.int64())
            ids = batch.column(0).filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), fits], ["id", "cluster", "distance"])

    kind = vectors.select(column(id_col)).schema[0].dataType.simpleString()
    placed = vectors.select(column(id_col).alias("id"), column(vector_col).alias("vector"))
    placed = stored(placed.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "assigned")
    # One row per centroid; a distance that is null makes its sums null.
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = placed.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), exact).alias("total"), F.count("*").alias("n")).collect()
    total = {r["cluster"]: None if r["total"] is None else int(r["total"]) for r in sums}
    whole_sum = None if None in total.values() else sum(total.values())
    long = lambda v: v if v is not None and v < 1 << 63 else None
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    facts = vectors.sparkSession.createDataFrame(
        [(c, long(t), long(whole_sum), name(c)) for c, t in total.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # At most k rows are broadcast.
    out = placed.join(F.broadcast(facts), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """DuckDB: distances to all centroids in every round."""
    near = """
        SELECT vec, arg_min(num, (d, num)) AS num, min(d) AS d FROM (
            SELECT p.vec, c.num, sum((p.v - c.v) * (p.v - c.v)) AS d
            FROM places p JOIN {centroids} c USING (place) GROUP BY p.vec, c.num
        ) GROUP BY vec"""
    parts = [
        f"""kept AS (
            SELECT row_number() OVER () AS vec, vec_id, embedding FROM embeddings
            WHERE len(embedding) = {dims}
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dims})""",
        f"""places AS (
            SELECT vec, place, floor({scale} * embedding[place]::DOUBLE)::HUGEINT AS v
            FROM kept, range(1, {dims} + 1) AS r(place))""",
        f"""firsts AS (
            SELECT vec, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS num
            FROM kept QUALIFY num < {k})""",
        "c0 AS (SELECT num, place, v FROM firsts JOIN places USING (vec))",
    ]
    for i in range(rounds):
        parts.append(f"near{i} AS ({near.format(centroids=f'c{i}')})")
        parts.append(
            f"""mean{i} AS (SELECT num, place, sum(v) AS s, count(*) AS n FROM near{i} JOIN places USING (vec) GROUP BY num, place)"""
        )
        parts.append(
            f"""c{i + 1} AS (
            SELECT num, place, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.v) AS v
            FROM c{i} c LEFT JOIN mean{i} m USING (num, place))"""
        )
    parts.append(f"last AS ({near.format(centroids=f'c{rounds}')})")
    parts.append(f"named AS (SELECT num, sha256(string_agg(v::VARCHAR, ',' ORDER BY place)) AS name FROM c{rounds} GROUP BY num)")
    return (
        "WITH " + ",\n".join(parts) + """
        SELECT k.vec_id, l.num::INTEGER AS cluster, l.d::BIGINT AS distance,
               (sum(l.d) OVER (PARTITION BY l.num))::BIGINT AS cluster_inertia,
               (sum(l.d) OVER ())::BIGINT AS inertia, n.name AS centroid_sha256
        FROM last l JOIN kept k USING (vec) JOIN named n USING (num)"""
    )


ORACLE_SQL = _oracle()
