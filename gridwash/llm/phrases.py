"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into segments of a few megabytes of text. Each segment is one stored
row with its own index: all its terms, sorted, and for each term its sorted positions. A
query (a window of consecutive test words) goes to every segment, as in any search
engine that is sharded by document: it starts from the window's rarest term there,
shifts that list by the term's offset, and intersects it with the lists of the other
terms from rare to frequent. Nothing of the corpus is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridwash.functions.cells import column
from gridwash.llm import words
from gridwash.llm.tables import stored

#: Bytes of text per segment.
SEGMENT = 1 << 22
#: Test windows sent to all tasks at once; more are searched in further blocks.
BLOCK = 200_000
#: Unused positions between two documents: no phrase and no proximity match spans them.
GAP = 64
#: Words that each word of a window may stand off in a proximity match of the query.
NEAR = 2

_INDEX = (
    "segment string, ids array<long>, keys array<long>, n_words array<int>, "
    "terms binary, counts binary, positions binary"
)
_FOUND = (
    "segment string, place int, id long, key long, n_words int, "
    "spans array<struct<s:int,e:int>>, items array<long>, near array<long>"
)


def windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, terms): ``size`` consecutive words of an item; all words of a shorter one."""

    def cut(batches):
        for batch in batches:
            for lo, hi, data, at in words.pieces(batch.column(1)):
                h, row, _, _ = words.hashed(data, at, words.ALNUM)
                h, bounds = words.signed(h), words.word_bounds(row, hi - lo)
                ids, terms = [], []
                for r in range(hi - lo):
                    own = h[bounds[r] : bounds[r + 1]]
                    if len(own):
                        for i in range(max(1, len(own) - size + 1)):
                            ids.append(batch.column(0)[lo + r].as_py())
                            terms.append(own[i : i + size])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["item", "terms"]
                )

    chosen = items.select(column(id_col).cast("long"), column(text_col).cast("binary"))
    return chosen.mapInArrow(cut, "item long, terms array<long>").distinct()


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per segment: its documents and the postings of all its terms."""

    def build(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, data, at in words.pieces(batch.column(1), SEGMENT):
                h, row, _, _ = words.hashed(data, at, words.ALNUM)
                position = (np.arange(len(h)) + row * GAP).astype(np.int32)
                order = np.argsort(h, kind="stable")
                new = np.ones(len(h), bool)
                new[1:] = h[order[1:]] != h[order[:-1]]
                first = np.flatnonzero(new)
                terms, counts = h[order[first]], np.diff(np.append(first, len(h))).astype(np.int32)
                n += 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": [f"{part}-{n}"],
                        "ids": [batch.column(0)[lo:hi]],
                        "keys": [batch.column(2)[lo:hi]],
                        "n_words": pa.array([np.bincount(row, minlength=hi - lo).astype(np.int32)]),
                        "terms": [terms.tobytes()],
                        "counts": [counts.tobytes()],
                        "positions": [position[order].tobytes()],
                    },
                    pa.schema(
                        [("segment", pa.string()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())),
                         ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()),
                         ("positions", pa.binary())]
                    ),
                )

    chosen = docs.select(
        column(id_col).cast("long"), column(text_col).cast("binary"), F.xxhash64(column(text_col))
    )
    return stored(chosen.mapInArrow(build, _INDEX), "index")


def _matches(keys, first, counts, local, offsets, slop: int):
    """(window, start, there) of every place where all terms of a window stand at their
    offsets, give or take ``slop`` words; ``there`` is the position of one of its words.
    local: term number of each window and offset (-1: none in this segment, -2: shorter
    window). A start within ``slop`` of where the rarest term puts it may do."""
    able = np.flatnonzero((local != -1).all(axis=1))
    local = local[able]
    often = np.where(local >= 0, counts[local], np.iinfo(np.int64).max)
    order = np.argsort(often, axis=1, kind="stable")
    rare = order[:, 0]
    pick = np.arange(len(able))
    term = local[pick, rare]
    n = counts[term]
    window = np.repeat(pick, n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    there = keys[np.repeat(first[term], n) + inner] & 0xFFFFFFFF
    shifts = np.arange(-slop, slop + 1)
    start = ((there - offsets[rare[window]])[:, None] + shifts).ravel()
    window, there = np.repeat(window, len(shifts)), np.repeat(there, len(shifts))
    for step in range(1, local.shape[1]):
        at = order[window, step]
        term = local[window, at]
        used = term >= 0
        low = np.maximum(start + offsets[at] - slop, 0)
        high = start + offsets[at] + slop
        i = np.searchsorted(keys, (term << 32) + low)
        met = keys[np.minimum(i, len(keys) - 1)]
        keep = ~used | ((i < len(keys)) & (met <= (term << 32) + high) & (high >= 0))
        window, start, there = window[keep], start[keep], there[keep]
    return able[window], start, there


def search(index: DataFrame, asked: list, size: int, slop: int = 0) -> DataFrame:
    """Every document with the spans of exact matches (word positions), the items they
    belong to, and with ``slop`` the items matched in proximity only.

    asked: [(item, terms)], at most ``BLOCK`` of them.
    """
    if slop >= GAP // 2:
        raise ValueError(f"slop must stay below {GAP // 2}")
    table = np.zeros((len(asked), size), np.int64)
    length = np.array([len(t) for _, t in asked], np.int64)
    for i, (_, terms) in enumerate(asked):
        table[i, : len(terms)] = terms
    vocabulary, inverse = np.unique(table.view(np.uint64), return_inverse=True)
    shared = index.sparkSession.sparkContext.broadcast(
        (vocabulary, inverse.reshape(table.shape), length, [i for i, _ in asked])
    )

    def find(batches):
        vocabulary, numbers, length, items = shared.value
        offsets = np.arange(numbers.shape[1])
        void = offsets[None, :] >= length[:, None]
        for batch in batches:
            for seg in batch.to_pylist():
                terms = np.frombuffer(seg["terms"], np.uint64)
                counts = np.frombuffer(seg["counts"], np.int32).astype(np.int64)
                n_words = np.array(seg["n_words"], np.int64)
                first = np.cumsum(counts) - counts
                keys = (np.repeat(np.arange(len(terms)), counts) << 32) + np.frombuffer(seg["positions"], np.int32)
                begin = np.cumsum(n_words) - n_words + np.arange(len(n_words)) * GAP
                spans, found, near = ({} for _ in range(3))
                if len(terms) and len(items):
                    i = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                    local = np.where(terms[i] == vocabulary, i, -1)[numbers]
                    local[void] = -2
                    window, start, there = _matches(keys, first, counts, local, offsets, 0)
                    place = np.searchsorted(begin, there, "right") - 1
                    lo = start - begin[place]
                    for p, w, s in sorted(zip(place.tolist(), window.tolist(), lo.tolist()), key=lambda x: (x[0], x[2])):
                        found.setdefault(p, set()).add(items[w])
                        own, e = spans.setdefault(p, []), s + int(length[w])
                        if own and s <= own[-1]["e"]:
                            own[-1]["e"] = max(own[-1]["e"], e)
                        else:
                            own.append({"s": s, "e": e})
                    if slop:
                        window, _, there = _matches(keys, first, counts, local, offsets, slop)
                        place = np.searchsorted(begin, there, "right") - 1
                        for p, w in zip(place.tolist(), window.tolist()):
                            if items[w] not in found.get(p, ()):
                                near.setdefault(p, set()).add(items[w])
                places = range(len(n_words))
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": [seg["segment"]] * len(n_words),
                        "place": pa.array(places, pa.int32()),
                        "id": pa.array(seg["ids"], pa.int64()),
                        "key": pa.array(seg["keys"], pa.int64()),
                        "n_words": pa.array(n_words, pa.int32()),
                        "spans": pa.array(
                            [spans.get(p, []) for p in places], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
                        ),
                        "items": pa.array([list(found.get(p, ())) for p in places], pa.list_(pa.int64())),
                        "near": pa.array([list(near.get(p, ())) for p in places], pa.list_(pa.int64())),
                    }
                )

    return index.mapInArrow(find, _FOUND)


def find_phrases(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    slop: int = 0,
) -> DataFrame:
    """Per document: id, key (hash of the text), n_words, n_hit, items, near.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. A window is
    ``size`` consecutive words of an item; an item of fewer words is one window. n_hit
    counts the document's words inside any exact occurrence; ``items`` has the items
    with occurrences; ``near`` those of which a window matches in proximity only: with
    every word at most ``slop`` places off where one alignment of the window puts it.

    Null and empty texts have no words; null ids are kept; an item with a null id marks
    words and counts as one item; repeated rows are each answered; other columns are
    ignored, whatever their names. Terms are told apart by 64-bit hashes.
    """
    asked = stored(windows(items, item_col, item_text_col, size), "windows")
    blocks = max(1, -(-asked.count() // BLOCK))
    index = build_index(docs, id_col, text_col)
    found = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.hash("terms"), F.lit(blocks)) == b) if blocks > 1 else asked
        part = search(index, [(r.item, r.terms) for r in own.collect()], size, slop)
        found = part if found is None else found.union(part)
    if blocks > 1:
        found = found.groupBy("segment", "place", "id", "key", "n_words").agg(
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")]
        )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    hit = F.aggregate(
        F.array_sort("spans"),
        start,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], x["e"]).alias("end"),
        ),
    )["n"]
    items_found = F.array_distinct("items")
    return found.select(
        F.col("id").alias(id_col),
        "key",
        F.col("n_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        items_found.alias("items"),
        F.array_except(F.array_distinct("near"), items_found).alias("near"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents without those that hold a window of an item; all columns kept.

    Copies of a row share its text, so they go or stay together.
    """
    hit = find_phrases(docs, items, id_col, text_col, **options).where("n_hit > 0")
    hit = hit.select(F.col(id_col).alias("_hit_id"), F.col("key").alias("_hit_key")).distinct()
    match = column(id_col).cast("long").eqNullSafe(F.col("_hit_id")) & (
        F.xxhash64(column(text_col)) == F.col("_hit_key")
    )
    return docs.join(hit, match, "left_anti")
