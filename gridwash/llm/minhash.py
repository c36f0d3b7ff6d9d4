"""MinHash near-duplicates by an inverted join of signature coordinates.

Two documents are linked if their sets of word shingles have a Jaccard similarity of at
least a threshold. Signatures only propose pairs: a pair must agree in at least
``MATCHES`` of the ``COORDINATES`` minima that are posted and in ``LIKE`` of the
``SKETCH`` minima in all; a pair at 0.8 misses either with probability below 1e-6. Every
proposed link is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwash.functions.cells import column
from gridwash.llm import words
from gridwash.llm.tables import components, stored

#: Minima that are posted, and how many of them a candidate pair must share.
COORDINATES, MATCHES = 20, 6
#: All minima (one byte of each is kept), and how many of them a candidate pair must share.
SKETCH, LIKE = 128, 79
#: Shingles of a list's members that are compared at once; larger lists are cut into blocks.
BLOCK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(77))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int):
    """(rows with words, offsets, hashes): the distinct shingles of each text, sorted.

    A text of fewer than ``size`` words is one shingle, its whole sequence.
    """
    h, row, _, _ = words.hashed(data, at, words.SPACED)
    rows = len(at) - 1
    bounds = words.word_bounds(row, rows)
    count = np.diff(bounds)
    n = max(0, len(h) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += h[j : j + n] * _PLACE[j]
    whole = row[:n] == row[size - 1 : size - 1 + n]
    short = np.flatnonzero((count > 0) & (count < size))
    own = count[short].astype(np.uint64) * _PLACE[-1]
    for j in range(size - 1):
        more = count[short] > j
        own[more] += h[bounds[short[more]] + j] * _PLACE[j]
    hashes = words.mix(np.concatenate([total[whole], own]))
    owner = np.concatenate([row[:n][whole], short])
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order].astype(np.uint16 if rows < 65536 else np.int64), kind="stable")]
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[first], owner[first]
    used, offsets = np.unique(owner, return_index=True)
    return used, np.append(offsets, len(hashes)), hashes


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, key, n, set_id, signature, sketch): key is a hash of the text, set_id of the set."""

    def sign(batches):
        for batch in batches:
            for lo, hi, data, at in words.pieces(batch.column(1)):
                used, offsets, h = shingle_sets(data, at, size)
                n = np.zeros(hi - lo, np.int64)
                ids = np.zeros((hi - lo, 2), np.uint64)
                values = np.zeros((hi - lo, SKETCH), np.uint32)
                if len(h):
                    n[used] = np.diff(offsets)
                    ids[used, 0] = np.add.reduceat(words.mix(h ^ _MASK[-1]), offsets[:-1])
                    ids[used, 1] = np.add.reduceat(words.mix(h ^ _MASK[-2]), offsets[:-1])
                    for j in range(SKETCH // 2):
                        # Both halves of a product are hash functions of their own.
                        halves = ((h ^ _MASK[j]) * _ODD[j]).view(np.uint32).reshape(-1, 2)
                        values[used, j] = np.minimum.reduceat(halves[:, 1].copy(), offsets[:-1])
                        values[used, SKETCH - 1 - j] = np.minimum.reduceat(halves[:, 0].copy(), offsets[:-1])
                posted = pa.array(values[:, :COORDINATES].copy().view(np.int32).ravel())
                at_posted = pa.array(np.arange(hi - lo + 1) * COORDINATES, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        batch.column(2)[lo:hi],
                        pa.array(n),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                        pa.ListArray.from_arrays(at_posted, posted),
                        pa.array([x.tobytes() for x in values.astype(np.uint8)], pa.binary()),
                    ],
                    ["id", "key", "n", "set_id", "signature", "sketch"],
                )

    chosen = docs.select(
        column(id_col).cast("long"), column(text_col).cast("binary"), F.xxhash64(column(text_col))
    )
    return chosen.mapInArrow(sign, "id long, key long, n long, set_id binary, signature array<int>, sketch binary")


def full_sets(docs: DataFrame, text_col: str, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) for the classes in ``nodes`` (node, key)."""

    def expand(batches):
        for batch in batches:
            for lo, hi, data, at in words.pieces(batch.column(1)):
                used, offsets, h = shingle_sets(data, at, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi].take(pa.array(used)), words.lists(words.signed(h), offsets)],
                    ["node", "shingles"],
                )

    texts = docs.select(F.xxhash64(column(text_col)).alias("key"), column(text_col).cast("binary").alias("_text"))
    found = texts.join(nodes, "key").select("node", "_text")
    # Copies of a text give equal sets; the group keeps one of them.
    sets = found.mapInArrow(expand, "node binary, shingles array<long>")
    return sets.groupBy("node").agg(F.first("shingles").alias("shingles"))


def prefix_lists(classes: DataFrame, matches: int) -> DataFrame:
    """(list, node, prefix): each class under the coordinate values of its prefix.

    Values that only one class has are dropped. The rest are ordered by how many classes
    post them, rarest first: two classes that share ``matches`` of them share one among
    all but the last ``matches - 1`` of either, so only those are posted.
    """
    posted = classes.select("node", F.posexplode("signature").alias("_c", "_v")).select(
        "node", (F.shiftleft(F.col("_c").cast("long"), 32) + F.col("_v").cast("long") + F.lit(1 << 31)).alias("list")
    )
    often = posted.groupBy("list").agg(F.count("*").alias("often")).where("often > 1")
    own = posted.join(often, "list").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("often", "list"))).alias("_all")
    )
    prefix = F.slice("_all", 1, F.size("_all") - (matches - 1))
    return (
        own.where(F.size("_all") >= matches)
        .select("node", F.array_sort(F.transform(prefix, lambda x: x["list"])).alias("prefix"))
        .select("node", F.explode("prefix").alias("list"), "prefix")
    )


def _agreeing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _led(members: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """(a, b): members confirmed to be like a leader of one of their lists.

    The leader of a list is its smallest node; a member is tried with the leader whose
    signature agrees most, so there is one row per member.
    """
    leaders = members.groupBy("list").agg(F.min(F.struct("node", "n", "signature")).alias("_l"))
    small, large = F.least("n", "_l.n"), F.greatest("n", "_l.n")
    agree = _agreeing(F.col("signature"), F.col("_l.signature"))
    tried = (
        members.join(leaders, "list")
        .where((F.col("node") != F.col("_l.node")) & (small * 100 >= large * percent))
        .select(F.col("node").alias("b"), "n", F.col("_l.node").alias("a"), F.col("_l.n").alias("na"), agree.alias("m"))
        .where(F.col("m") >= matches)
        .groupBy("b").agg(F.max_by(F.struct("a", "na", F.col("n").alias("nb")), F.struct("m", "a")).alias("_x"))
        .select("b", "_x.*")
    )
    return _confirm(tried, sets, percent)


def _within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the groups of each list.

    members: (list, node, n, root, sketch, prefix). Each block of a list meets itself and
    every later block. A pair of different groups is confirmed on the full sets, in the
    first list that both have in their prefixes, if its sketches agree often enough;
    a confirmed link merges the two groups for the rest of the block, so no task passes on
    more links than it has members.
    """
    sizes = members.groupBy("list").agg(
        F.ceil(F.sum("n") / BLOCK).cast("int").alias("_parts"), F.min("root").alias("_x"), F.max("root").alias("_y")
    )
    sizes = sizes.where("_x <> _y").select("list", "_parts")
    own = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("_parts") - 1)
    rows = (
        members.join(sizes, "list").join(sets, "node").withColumn("_own", own)
        .withColumn("_other", F.explode(other))
        .withColumn("_x", F.least("_own", "_other")).withColumn("_y", F.greatest("_own", "_other"))
        .select("list", "_x", "_y", F.col("_own").alias("own"), "node", F.xxhash64("root").alias("root"), "sketch", "prefix", "shingles")
        .repartition("list", "_x", "_y")
        .sortWithinPartitions("list", "_x", "_y")
    )

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cut = _group_starts(held)
            if len(cut) > 1:
                yield from _links_of(held.slice(0, cut[-1]), cut, percent)
                held = held.slice(cut[-1])
        if held is not None and held.num_rows:
            yield from _links_of(held, np.append(_group_starts(held), held.num_rows), percent)

    return rows.mapInArrow(compare, "a binary, b binary").distinct()


def _group_starts(table: pa.Table) -> np.ndarray:
    keys = np.stack([table.column(i).to_numpy().astype(np.int64) for i in range(3)])
    return np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]) if table.num_rows else np.zeros(0, int)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks()
    return np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays have in common."""
    a, b = (a, b) if len(a) < len(b) else (b, a)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _links_of(table: pa.Table, cut: np.ndarray, percent: int):
    """Links of the groups of rows between the row numbers in ``cut``."""
    lists, first, second, own = (table.column(i).to_numpy() for i in range(4))
    root = table.column("root").to_numpy()
    flat = b"".join(x.as_buffer().to_pybytes() for x in table.column("sketch"))
    sketch = np.frombuffer(flat, np.uint8).reshape(-1, SKETCH)
    prefixes, sets = _arrays(table.column("prefix")), [np.sort(x) for x in _arrays(table.column("shingles"))]
    n = np.array([len(x) for x in sets])
    found = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        _, group = np.unique(root[lo:hi], return_inverse=True)
        if group.max() == 0:
            continue
        left = np.flatnonzero(own[lo:hi] == first[lo])
        right = left if first[lo] == second[lo] else np.flatnonzero(own[lo:hi] == second[lo])
        for start in range(0, len(left), 64):
            some = left[start : start + 64]
            small, large = (f(n[lo + some][:, None], n[lo + right][None, :]) for f in (np.minimum, np.maximum))
            able = (group[some][:, None] != group[right][None, :]) & (small * 100 >= percent * large)
            if first[lo] == second[lo]:
                able &= some[:, None] < right[None, :]
            i, j = np.nonzero(able)
            agree = np.concatenate(
                [np.zeros(0, np.int64)]
                + [
                    (sketch[lo + some[i[at : at + 65536]]] == sketch[lo + right[j[at : at + 65536]]]).sum(1)
                    for at in range(0, len(i), 65536)
                ]
            )
            good = np.flatnonzero(agree >= LIKE)
            for k in good[np.argsort(-agree[good], kind="stable")]:
                x, y = some[i[k]], right[j[k]]
                if group[x] == group[y] or np.intersect1d(prefixes[lo + x], prefixes[lo + y], assume_unique=True)[0] != lists[lo]:
                    continue
                both = _shared(sets[lo + x], sets[lo + y])
                if 100 * both >= percent * (n[lo + x] + n[lo + y] - both):
                    found.append((lo + x, lo + y))
                    group[group == group[y]] = group[x]
    if found:
        nodes = table.column("node").combine_chunks()
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(side)) for side in zip(*found)], ["a", "b"])


def link(classes: DataFrame, docs: DataFrame, text_col: str, size: int, percent: int, matches: int) -> DataFrame | None:
    """(node, root) for all classes that any confirmed link joins; None without links.

    First every member of a list is tried with one leader; what is confirmed gives groups.
    Then the lists whose members are in different groups are compared throughout. So each
    pair of a list has been tested or lies within one group, no pairs are handed around,
    and groups of copies cost one row per member.
    """
    lists = prefix_lists(classes, matches)
    several = lists.groupBy("list").agg(F.count("*").alias("_n")).where("_n > 1").select("list")
    facts = classes.select("node", "n", "signature", "sketch")
    members = stored(lists.join(several, "list").join(facts, "node"), "members")
    if members.isEmpty():
        return None
    needed = members.select("node").distinct().join(classes.select("node", "key"), "node")
    sets = stored(full_sets(docs, text_col, needed, size), "sets")
    led = _led(members, sets, percent, matches)
    # Leaders are smaller than their members, so this is a forest; two steps up are enough
    # to tell most groups, and a group told apart only costs comparisons.
    up = led.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(2):
        above = led.select(F.col("b").alias("root"), F.col("a").alias("_up"))
        up = up.join(above, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    grouped = members.join(up, "node", "left").select(
        "list", "node", "n", F.coalesce("root", "node").alias("root"), "sketch", "prefix"
    )
    links = stored(led.union(_within(grouped, sets, percent)), "links")
    return None if links.isEmpty() else stored(components(links), "roots")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb")), "b"
    )
    shared = F.size(F.array_intersect("_sa", "_sb"))
    sure = both.where(shared * 100 >= percent * (F.col("na") + F.col("nb") - shared))
    return stored(sure.select("a", "b"), "confirmed")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4,
    percent: int = 80,
    matches: int = MATCHES,
) -> DataFrame:
    """Per document: id, key (hash of the text), n_shingles, component_id, class_id.

    A document's set holds its distinct shingles of ``size`` words (runs of bytes other
    than white space, A-Z lower-cased). Documents with 100 * intersection >= ``percent``
    * union are linked; component_id is the smallest id reachable. Equal sets are one
    class before any pair is formed, so copies cost nothing further.

    Null and empty texts have no shingles, are linked with nothing and are their own
    component, as are their repeated rows. Repeated rows are copies of each other. A null
    id never is the smallest; a component of null ids only has a null component_id. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    signed = stored(signatures(docs, id_col, text_col, size), "signed")
    classes = stored(
        signed.where("n > 0").groupBy(F.col("set_id").alias("node")).agg(
            F.first("n").alias("n"), F.first("signature").alias("signature"),
            F.first("sketch").alias("sketch"), F.min("key").alias("key"),
        ),
        "classes",
    )
    roots = link(classes, docs, text_col, size, percent, matches)
    placed = signed.select("id", "key", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("node"))
    if roots is not None:
        placed = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        placed = placed.withColumn("root", F.col("node"))
    placed = stored(placed, "placed")
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("_least"))
    return placed.join(least, "root", "left").select(
        F.col("id").alias(id_col),
        "key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("_least")).alias("component_id"),
        F.col("root").alias("class_id"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component: the one with the smallest id; all columns kept.

    Of repeated rows with that id one stays; documents without words all stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options).select(
        F.col(id_col).alias("id"), F.col("key"), F.col("class_id").alias("class")
    )
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.col("id").asc_nulls_last(), "key"))
    stays = found.where("class IS NOT NULL").withColumn("rank", rank).where("rank = 1").withColumn("every", F.lit(False))
    wordless = found.where("class IS NULL").select("id", "key").distinct().withColumn("every", F.lit(True))
    keep = stays.select("id", "key", "every").union(wordless)
    # One shuffle of the texts: the window groups by the keys of the join. A null id is
    # compared as a number of its own.
    keys = ["_id", "_null", "_key"]
    mark = lambda i, k: [F.coalesce(i, F.lit(0)).alias("_id"), i.isNull().alias("_null"), k.alias("_key")]
    rows = docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("_row"),
        *mark(column(id_col).cast("long"), F.xxhash64(column(text_col))),
    )
    joined = rows.join(keep.select(*mark(F.col("id"), F.col("key")), "every"), keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    kept = joined.withColumn("_first", first).where("every OR _first = 1")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
