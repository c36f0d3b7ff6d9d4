"""Approximate nearest neighbours with balanced posting lists.

Vectors are posted in the lists of their nearest centroids: a vector near a boundary is
replicated to several lists, unless a list already chosen stands between. Centroids are
balanced k-means of a bounded sample, few enough to be sent to all tasks, and searched
by a walk over their neighbour graph. A query reads the lists whose centroids are at
most a ratio farther than the nearest one. Equal vectors are posted once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwash.functions.cells import column
from gridwash.llm.tables import stored

#: Distinct vectors the centroids are fitted on, and the most centroids.
SAMPLE, CENTROIDS = 20_000, 4096
#: Aimed vectors per list; vectors of a list that one task compares at once, and queries.
LIST, BLOCK, ASKED = 128, 20_000, 20_000
#: Pairs scored at once in double precision.
PAIRS = 1 << 16
#: Neighbours of a centroid in the graph, width of the walk, nodes expanded at a step.
DEGREE, BEAM, STEP = 24, 96, 4
#: Lists a vector is posted in and a query reads, at most, and the distance ratios.
COPIES, PROBES, LEAST = 6, 64, 8
COPY_RATIO, PROBE_RATIO = 1.15, 1.3


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty, not zero and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def matrix(lists: pa.Array, kind=np.float32) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; no result depends on other rows."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def rounding(size: int) -> float:
    """Most that a product of two unit vectors in single precision, summed in any order,
    is away from their computed cosine in double precision.

    With u = 2**-24, both vectors' components and their products are rounded and summed
    with a relative error of at most (1 + u)**(size + 2) - 1 of a sum of absolute products
    that is at most 1; the computed cosine and the norms of the unit vectors are off by
    less than u together.
    """
    return float(np.expm1((size + 3) * np.log1p(2.0**-24)) + size * 2.0**-40)


def _best(keys, score, near, id_at, id_of, most: int):
    """[key, score, id] of the ``most`` best ids of each key, ties to the smaller id."""
    n = np.diff(id_at)[near]
    key, score = np.repeat(keys, n), np.repeat(score, n)
    ids = id_of[np.repeat(id_at[:-1][near] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    once = np.lexsort((-score, ids, key))
    same = np.zeros(len(once), bool)
    same[1:] = (key[once[1:]] == key[once[:-1]]) & (ids[once[1:]] == ids[once[:-1]])
    once = once[~same]
    order = once[np.lexsort((ids[once], -score[once], key[once]))]
    first = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    place = np.arange(len(order))
    order = order[place - np.maximum.accumulate(np.where(first, place, 0)) < most]
    return [pa.array(key[order]), pa.array(score[order]), pa.array(ids[order])]


def balanced_centroids(x: np.ndarray, count: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means whose crowded clusters repel: a cluster's size adds to its distance."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), count, replace=False)].copy()
    weight = np.zeros(count)
    for _ in range(rounds):
        near = np.empty(len(x), np.int64)
        for lo in range(0, len(x), 2048):
            near[lo : lo + 2048] = np.argmin(weight - 2 * (x[lo : lo + 2048] @ centroids.T), axis=1)
        size = np.bincount(near, minlength=count)
        weight = 0.5 * weight + 0.1 * (size / size.mean() - 1)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(size)
        sums = np.add.reduceat(x[order], np.searchsorted(near[order], full))
        centroids[full] = unit(sums)
        for empty in np.flatnonzero(size == 0):
            centroids[empty] = x[rng.integers(len(x))]
    return centroids


def neighbour_graph(centroids: np.ndarray, degree: int = DEGREE, seed: int = 9) -> np.ndarray:
    """Nearest centroids of each centroid, and some far ones so that no part is cut off."""
    count = len(centroids)
    near = min(degree, count)
    far = np.random.default_rng(seed).integers(count, size=(count, 4))
    out = np.empty((count, near), np.int64)
    for lo in range(0, count, 1024):
        sims = centroids[lo : lo + 1024] @ centroids.T
        out[lo : lo + 1024] = np.argsort(-sims, axis=1, kind="stable")[:, :near]
    return np.hstack([out, far])


def walk(queries: np.ndarray, centroids: np.ndarray, graph: np.ndarray, want: int):
    """(centroid numbers, distances) of the ``want`` nearest centroids of each query.

    Best-first over the graph, for many queries at once: the best unexpanded nodes of
    each query's beam are expanded until its beam holds none.
    """
    count, beam = len(centroids), max(BEAM, want)
    out_ids, out_d = [], []
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        n = np.arange(len(q))[:, None]
        start = np.unique(np.linspace(0, count - 1, min(count, 32)).astype(np.int64))
        seen = np.zeros((len(q), count), bool)
        seen[:, start] = True
        ids = np.full((len(q), beam), -1)
        sims = np.full((len(q), beam), -np.inf, np.float32)
        done = np.ones((len(q), beam), bool)
        ids[:, : len(start)], sims[:, : len(start)], done[:, : len(start)] = start, q @ centroids[start].T, False
        while True:
            pick = np.argsort(np.where(done, np.inf, -sims), axis=1, kind="stable")[:, :STEP]
            fresh = ~done[n, pick]
            if not fresh.any():
                break
            done[n, pick] = True
            around = graph[np.where(fresh, ids[n, pick], 0)].reshape(len(q), -1)
            new = np.repeat(fresh, graph.shape[1], axis=1) & ~seen[n, around]
            seen[n, around] |= new
            # A node that two expanded nodes share is taken once.
            around = np.where(new, around, -1)
            around.sort(axis=1)
            new = around >= 0
            new[:, 1:] &= around[:, 1:] != around[:, :-1]
            sim = np.full(around.shape, -np.inf, np.float32)
            at, _ = np.nonzero(new)
            sim[new] = np.einsum("ij,ij->i", q[at], centroids[around[new]])
            every = np.hstack([sims, sim])
            best = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            ids = np.hstack([ids, around])[n, best]
            sims = every[n, best]
            done = np.hstack([done, ~new])[n, best]
        order = np.argsort(-sims, axis=1, kind="stable")[:, :want]
        out_ids.append(ids[n, order])
        out_d.append(np.sqrt(np.maximum(2 - 2 * sims[n, order], 0)))
    return np.vstack(out_ids), np.vstack(out_d)


def _lists_of(x: np.ndarray, model, want: int, ratio: float, least: int, spread: bool):
    """(row, list) pairs: the nearest lists within the ratio of the nearest distance."""
    centroids, graph = model
    ids, dist = walk(x, centroids, graph, min(want, len(centroids)))
    keep = (ids >= 0) & ((dist <= ratio * dist[:, :1] + 1e-6) | (np.arange(ids.shape[1]) < least))
    if spread:
        # Leave out a list whose centroid is nearer to a list already taken than to the vector.
        for j in range(1, ids.shape[1]):
            for i in range(j):
                apart = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", centroids[ids[:, i]], centroids[ids[:, j]]), 0))
                keep[:, j] &= ~keep[:, i] | (apart > dist[:, j])
    return np.nonzero(keep)[0], ids[keep]


def _posted(vectors: DataFrame, shared, want, ratio, least, spread) -> DataFrame:
    def post(batches):
        for batch in batches:
            if batch.num_rows:
                row, lists = _lists_of(unit(matrix(batch.column(1))), shared.value, want, ratio, least, spread)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists), *(c.take(at) for c in batch.columns)], ["list", *batch.schema.names])

    return vectors.mapInArrow(post, "list long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema))


def _parts(rows: DataFrame, most: int) -> Column:
    """Blocks of at most about ``most`` rows that the rows of a list are cut into."""
    # At most one row per centroid.
    counts = {r["list"]: -(-r["count"] // most) for r in rows.groupBy("list").count().collect()}
    several = [F.lit(v) for pair in counts.items() if pair[1] > 1 for v in pair]
    return F.coalesce(F.create_map(*several)[F.col("list")], F.lit(1)) if several else F.lit(1)


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    k: int = 5,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but
    those with the query's id. Nearest by cosine in double precision on the original
    vectors, ties to the smaller id.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no
    part, nor do rows without an id or of another length than most; repeated rows count
    once; an empty table gives no rows; fewer candidates than ``k`` give fewer rows.
    """
    given = vectors.select(column(vector_col)).schema[0].dataType.simpleString()
    kind = "float" if given == "array<float>" else "double"
    rows = vectors.select(column(id_col).cast("long").alias("id"), column(vector_col).cast(f"array<{kind}>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    # -0.0 and 0.0 are one value.
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind)))
    rows = rows.select("id", "vec", F.xxhash64("vec").alias("key"))
    sizes = rows.groupBy(F.size("vec").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    if sizes is None:
        return rows.select(
            F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")
        )
    rows = rows.where(F.size("vec") == sizes["s"]).dropDuplicates(["id", "key"])
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest of a query.
    least = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    firsts = rows.withColumn("_r", least).where(F.col("_r") <= k + 1)
    single = stored(
        firsts.groupBy("key").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids")), "vectors"
    )
    queries = stored(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "key"), "queries")
    n = single.count()
    sample = single.select("vec", "key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()
    x = unit(matrix(sample.column(0).combine_chunks()))
    count = max(1, min(CENTROIDS, len(x), -(-n // LIST)))
    centroids = balanced_centroids(x, count)
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, neighbour_graph(centroids)))
    postings = stored(_posted(single.select("key", "vec", "ids"), shared, COPIES, COPY_RATIO, 1, True), "postings")
    asked = single.join(queries.select("key").distinct(), "key").select("key", "vec")
    asked = stored(_posted(asked, shared, PROBES, PROBE_RATIO, LEAST, False), "asked")
    # A crowded list is cut into blocks on both sides; every block of queries meets every
    # block of vectors.
    blocks, turns = _parts(postings, BLOCK), _parts(asked, ASKED)
    every = lambda parts: F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))
    own = lambda parts: F.pmod(F.col("key"), parts).cast("int")
    placed = postings.withColumn("block", own(blocks)).withColumn("turn", every(turns))
    asked = asked.withColumn("block", every(blocks)).withColumn("turn", own(turns))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = pa.schema([("key", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return names.empty_table()
        q, v = (matrix(t.column("vec").combine_chunks(), np.float64) for t in (left, right))
        uq, uv = unit(q), unit(v)
        keys, ids = left.column("key").to_numpy(), right.column("ids").combine_chunks()
        id_at, id_of = ids.offsets.to_numpy(), ids.values.to_numpy()
        # An id may have several vectors: the k + 1 best are counted by the vectors' smallest ids.
        order = np.argsort(id_of[id_at[:-1]], kind="stable")
        groups = np.unique(id_of[id_at[:-1]][order], return_index=True)[1]
        top = min(len(groups), k + 1)
        out = []
        for lo in range(0, len(q), 64):
            sims = uq[lo : lo + 64] @ uv.T
            best = np.maximum.reduceat(sims[:, order], groups, axis=1) if len(groups) < len(v) else sims
            least = -np.partition(-best, top - 1, axis=1)[:, top - 1] - 2 * rounding(q.shape[1])
            own, near = np.nonzero(sims >= least[:, None])
            score = np.concatenate([cosine(q[lo + own[i : i + PAIRS]], v[near[i : i + PAIRS]]) for i in range(0, len(own), PAIRS)])
            out.append(pa.table(_best(keys[lo + own], score, near, id_at, id_of, k + 1), schema=names))
        return pa.concat_tables(out)

    found = (
        asked.groupBy("list", "block", "turn").cogroup(placed.groupBy("list", "block", "turn"))
        .applyInArrow(compare, "key long, score double, vec_id long")
    )
    order = (F.desc("score"), F.asc("vec_id"))
    best = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    best = stored(
        best.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("_r") <= k + 1), "best"
    )
    own = queries.join(best.drop("_r"), "key").where(F.col("query_id") != F.col("vec_id"))
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*order)))
    return own.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
