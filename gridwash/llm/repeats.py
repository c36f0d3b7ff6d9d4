"""Repeated byte strings across a corpus, by prefix-free parsing.

A rolling hash over short windows sets triggers: the places where it is least within a
radius. They depend on the neighbouring bytes only, so equal strings get equal triggers
and are parsed into equal phrases, wherever they stand. Every start of a string belongs
to the first trigger it holds, so the starts before one trigger form one block, and
blocks are compared instead of single bytes:

1. a block whose context around the trigger is unique in the corpus holds no repeat;
2. if the whole stretch its strings cover occurs twice, all its starts repeat;
3. only what is left, the surroundings of places where copies diverge, is compared
   start by start.

Strings are compared by hashes of 128 bits. The order among different strings is never
needed, so the suffix arrays of dictionary and parse are cut at the given length and
kept as equivalence classes (equal up to that length) instead of sorted ranks.
"""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridwash.functions.cells import column
from gridwash.llm import words
from gridwash.llm.tables import drop_stored, stored

#: Bytes under the rolling hash, and the shortest strings that can be asked for.
GRAM, SHORTEST = 12, 64
#: Different contexts of a trigger that one task compares; more are compared by a join.
CROWD = 4096


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over ``width`` places from each place on (as long as they fit)."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def context(length: int) -> tuple[int, int]:
    """(radius of the minima, bytes kept right of a trigger) for strings of ``length``:
    an eighth of them each, so that most strings hold a trigger with its context."""
    radius = (length - 16) // 8
    return radius, radius + 16


def triggers(rolling: words.Rolling, n: int, radius: int) -> np.ndarray:
    """Places whose hash is less than all before and at most all after, within the radius."""
    count = n - GRAM + 1
    if count <= 2 * radius:
        return np.zeros(0, np.int64)
    at = np.arange(count)
    value = (rolling(at, at + GRAM) >> np.uint64(32)).astype(np.uint32)
    near = _least(value, radius)
    middle = value[radius : count - radius]
    chosen = (middle < near[: len(middle)]) & (middle <= near[radius + 1 : radius + 1 + len(middle)])
    return np.flatnonzero(chosen) + radius


def blocks(data: np.ndarray, at: np.ndarray, length: int):
    """Blocks of one piece: (row, lo, hi, key, full, lone); lo, hi count from the row's start.

    Starts without a usable trigger are lone blocks of their own.
    """
    radius, right = context(length)
    reach = length - right
    first, second = words.Rolling(data), words.Rolling(data, 1)
    q = triggers(first, len(data), radius)
    row = np.searchsorted(at, q, "right") - 1
    inside = (q - radius >= at[row]) & (q + radius + GRAM <= at[row + 1])
    q, row = q[inside], row[inside]
    begin, last = at[row], at[row + 1] - length
    before = np.full(len(q), -1)
    if len(q):
        before[1:] = np.where(row[1:] == row[:-1], q[:-1], -1)
    lo = np.maximum(np.where(before < 0, begin, before - radius + 1), np.maximum(begin, q - reach))
    hi = np.minimum(q - radius, last)
    some = lo <= hi
    q, row, lo, hi = q[some], row[some], lo[some], hi[some]
    key = first(q - radius, q + right)
    stop = np.minimum(hi + length, at[row + 1])
    full = words.mix(second(lo, stop) + (stop - lo).astype(np.uint64))
    # Starts that no block holds.
    cover = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(at) >= length)
    np.add.at(cover, at[long], 1)
    np.add.at(cover, at[long + 1] - length + 1, -1)
    np.add.at(cover, lo, -1)
    np.add.at(cover, hi + 1, 1)
    alone = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    own = np.searchsorted(at, alone, "right") - 1
    key = np.concatenate([key, first(alone, alone + length)])
    full = np.concatenate([full, second(alone, alone + length)])
    lone = np.arange(len(row) + len(own)) >= len(row)
    row = np.concatenate([row, own])
    return row, np.concatenate([lo, alone]) - at[row], np.concatenate([hi, alone]) - at[row], key, full, lone


def _runs(positions: np.ndarray):
    """Runs of consecutive numbers in a sorted array: first and last of each."""
    cut = np.flatnonzero(np.diff(positions) > 1)
    return positions[np.r_[0, cut + 1]], positions[np.r_[cut, len(positions) - 1]]


def _block_table(texts: DataFrame, length: int) -> DataFrame:
    """(key, full, uid, span, n, lone): blocks of all texts (uid, text).

    Equal lone starts within a text (long runs of one pattern) are one block that counts
    n times; the runs of their starts are known to repeat and are rows with a null key.
    """

    def cut(batches):
        for batch in batches:
            for r0, r1, data, at in words.pieces(batch.column(1)):
                if not (np.diff(at) >= length).any():
                    continue
                row, lo, hi, key, full, lone = blocks(data, at, length)
                n = np.ones(len(row), np.int64)
                keep = np.ones(len(row), bool)
                extra = []
                one = np.flatnonzero(lone)
                order = one[np.lexsort((lo[one], full[one], key[one], row[one]))]
                if len(order):
                    new = np.ones(len(order), bool)
                    for values in (row, key, full):
                        own = values[order]
                        new[1:] &= own[1:] == own[:-1]
                    new[1:] = ~new[1:]
                    heads = np.flatnonzero(new)
                    size = np.diff(np.append(heads, len(order)))
                    n[order[heads]] = size
                    keep[order[~new]] = False
                    again = order[np.repeat(size > 1, size)]
                    place = np.sort((row[again].astype(np.int64) << 32) + lo[again])
                    if len(place):
                        extra = list(zip(*_runs(place)))
                uid = batch.column(0)[r0:r1]
                row, lo, hi, key, full, n, lone = (x[keep] for x in (row, lo, hi, key, full, n, lone))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(words.signed(key)), pa.array(words.signed(full)), uid.take(pa.array(row)),
                        pa.array((lo << 32) + hi), pa.array(n), pa.array(lone),
                    ],
                    ["key", "full", "uid", "span", "n", "lone"],
                )
                if extra:
                    rows = np.array([a >> 32 for a, _ in extra])
                    spans = [((int(a) & 0xFFFFFFFF) << 32) + (int(b) & 0xFFFFFFFF) for a, b in extra]
                    none = pa.nulls(len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [none, none, uid.take(pa.array(rows)), pa.array(spans), none, pa.nulls(len(rows), pa.bool_())],
                        ["key", "full", "uid", "span", "n", "lone"],
                    )

    return texts.mapInArrow(cut, "key long, full long, uid long, span long, n long, lone boolean")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """(key, uid, start, bytes, asked): what the strings of each block to be compared cover."""

    def spread(batches):
        for batch in batches:
            rows = [[] for _ in range(5)]
            for uid, text, blocks in zip(batch.column(0), words.binary(batch.column(1)), batch.column(2)):
                data = text.as_buffer()
                for block in blocks.as_py():
                    lo, hi = block["span"] >> 32, block["span"] & 0xFFFFFFFF
                    own = (block["key"], uid.as_py(), lo, data[lo : hi + length].to_pybytes(), block["asked"])
                    for column, value in zip(rows, own):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, k) for r, k in zip(rows, kinds)], ["key", "uid", "start", "bytes", "asked"]
            )

    return texts.mapInArrow(spread, "key long, uid long, start int, bytes binary, asked boolean")


def _windows(table: pa.Table, length: int):
    """Every string of some contexts: (number of the context, start in the text, two hashes)."""
    column = words.binary(table.column("bytes").combine_chunks())
    first_start = table.column("start").to_numpy()
    for r0, r1, data, at in words.pieces(column):
        n = np.diff(at) - length + 1
        row = np.repeat(np.arange(r1 - r0), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        there = at[row] + inner
        first, second = words.Rolling(data), words.Rolling(data, 1)
        yield row + r0, first_start[row + r0] + inner, first(there, there + length), second(there, there + length)


def _compare_near(contexts: DataFrame, length: int) -> DataFrame:
    """(uid, start): asked starts whose string occurs twice among the contexts of a key.

    Contexts of a key stand together in a sorted partition; a task holds whole keys, of
    which each has at most ``CROWD`` different contexts.
    """

    def alike(table: pa.Table):
        asked, uid = table.column("asked").to_numpy(), table.column("uid").to_numpy()
        parts = list(zip(*_windows(table, length)))
        row, start, h1, h2 = (np.concatenate(x) for x in parts)
        order = np.lexsort((h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = order[twice]
        found = found[asked[row[found]]]
        return pa.RecordBatch.from_arrays([pa.array(uid[row[found]]), pa.array(start[found], pa.int32())], ["uid", "start"])

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = held.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if held.num_rows else 0
            if cut:
                yield alike(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield alike(held)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "uid long, start int")


def _compare_far(contexts: DataFrame, length: int) -> DataFrame:
    """As ``_compare_near``, start by start, for keys with any number of contexts."""

    def spread(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            asked, uid = table.column("asked").combine_chunks(), table.column("uid").combine_chunks()
            for row, start, h1, h2 in _windows(table, length):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.signed(h1)), pa.array(words.signed(h2)), uid.take(at), pa.array(start, pa.int32()), asked.take(at)],
                    ["h1", "h2", "uid", "start", "asked"],
                )

    starts = stored(contexts.mapInArrow(spread, "h1 long, h2 long, uid long, start int, asked boolean"), "starts")
    common = starts.groupBy("h1", "h2").agg(F.count("*").alias("_c")).where("_c > 1").select("h1", "h2")
    return starts.where("asked").join(common, ["h1", "h2"]).select("uid", "start")


def find_repeats(
    docs: DataFrame, text_col: str = "text", length: int = 400, whole_characters: bool = False, least_words: int = 0
) -> DataFrame:
    """(row, absent, n_bytes, n_removed, n_spans, kept) for the rows of ``docs``.

    ``row`` is a struct of all columns but the text, ``absent`` tells a null text.

    A byte is removed if a string of ``length`` bytes that covers it also starts
    anywhere else, in this text or another; overlaps count; strings never cross texts
    and are judged on the input. n_spans counts maximal removed runs, ``kept`` holds the
    remaining bytes; with ``whole_characters`` without the parts of characters that a cut
    leaves over. Runs that hold fewer than ``least_words`` whole words (split at white
    space) stay: they count neither in n_removed nor in n_spans.

    Null texts count as empty; texts below ``length`` bytes keep all; repeated rows and
    copies remove each other whole; an empty table gives no rows; columns may have any
    names. ``length`` must be at least ``SHORTEST`` for the trigger's context to fit; the
    shorter it is, the more blocks a text has.
    """
    untouched, touched = _compared(docs, text_col, length)
    kind = touched.schema["row"].dataType.simpleString()
    removed = touched.mapInArrow(
        _remover(length, whole_characters, least_words),
        f"row {kind}, n_bytes long, n_removed long, n_spans long, kept binary",
    )
    found = _unchanged(untouched).union(removed)
    return found.select(F.col("row.row").alias("row"), F.col("row.absent").alias("absent"), *found.columns[1:])


def _unchanged(texts: DataFrame, *more) -> DataFrame:
    none = F.lit(0).cast("long")
    return texts.select(
        "row", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.col("text").alias("kept"), *more,
    )


def repeats_and_passages(
    docs: DataFrame, text_col: str = "text", length: int = 400, passage_bytes: int = 200, passage_words: int = 51
) -> DataFrame:
    """As ``find_repeats`` at ``length``, with n_passages: the runs of at least
    ``passage_words`` whole words that strings of ``passage_bytes`` bytes, which also start
    elsewhere, make up together. They are told, not removed.

    Strings of the smaller size are looked for in all texts. One of ``length`` bytes that
    occurs twice lies in a run of at least so many bytes both times, so the texts without
    such a run have none, and only the others are compared again.
    """
    if passage_bytes > length:
        raise ValueError("passage_bytes must not be above length")
    untouched, touched = _compared(docs, text_col, passage_bytes)
    kind = touched.schema["row"].dataType.simpleString()
    seen = stored(
        touched.mapInArrow(_measurer(passage_bytes, passage_words), f"row {kind}, text binary, n_passages long, longest long"),
        "seen", "zstd",
    )
    again = find_repeats(seen.where(F.col("longest") >= length).select("row", "n_passages", "text"), "text", length)
    again = again.select(F.col("row.row").alias("row"), "n_bytes", "n_removed", "n_spans", "kept", F.col("row.n_passages").alias("n_passages"))
    none = F.lit(0).cast("long").alias("n_passages")
    found = _unchanged(untouched, none).union(_unchanged(seen.where(F.col("longest") < length), "n_passages")).union(again)
    return found.select(F.col("row.row").alias("row"), F.col("row.absent").alias("absent"), *found.columns[1:])


def _compared(docs: DataFrame, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """(row, text) of the texts that no block of repeated strings touches, and (row, text,
    sure, starts) of the others: blocks all of whose strings occur again, and single
    starts of such strings. ``row`` holds ``absent`` and the other columns as ``row``."""
    if length < SHORTEST:
        raise ValueError(f"length must be at least {SHORTEST} bytes")
    text = F.coalesce(column(text_col).cast("binary"), F.lit(b""))
    # The text travels once; the struct holds all else.
    others = [column(c) for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    texts = docs.select(
        F.struct(column(text_col).isNull().alias("absent"), F.struct(*others).alias("row")).alias("row"),
        text.alias("text"),
        F.xxhash64(text).alias("uid"),
        F.monotonically_increasing_id().alias("order"),
    )
    every = stored(_block_table(texts.select("uid", "text"), length), "blocks")
    twice = every.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("_c")).where("_c > 1").select("key")
    known = every.where("key IS NULL")
    alive = stored(every.join(twice, "key").unionByName(known), "alive")
    drop_stored(every)
    keyed = alive.where("key IS NOT NULL")
    wholes = keyed.groupBy("key", "full").agg(F.sum("n").alias("c"), F.min("uid").alias("lender"))
    wholes = kept = stored(wholes, "wholes")
    varied = wholes.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wholes = wholes.join(varied, "key", "left")
    lent = (F.col("c") > 1) & F.col("kinds").isNotNull() & ~F.col("lone") & (F.col("uid") == F.col("lender"))
    asked = (F.col("c") == 1) & F.col("kinds").isNotNull() & ~F.col("lone")
    marked = keyed.join(wholes, ["key", "full"]).select(
        "uid", "span",
        (F.col("c") > 1).alias("sure"),
        F.when(lent | asked, F.col("key")).alias("key"),
        asked.alias("asked"),
        (F.coalesce("kinds", F.lit(0)) > CROWD).alias("far"),
    ).where("sure OR key IS NOT NULL")
    marked = marked.union(
        alive.where("key IS NULL").select("uid", "span", F.lit(True), "key", F.lit(False), F.lit(False))
    ).distinct()
    block = F.when(F.col("key").isNotNull(), F.struct("span", "key", "asked", "far"))
    states = marked.groupBy("uid").agg(
        F.collect_list(F.when(F.col("sure"), F.col("span"))).alias("sure"), F.collect_list(block).alias("blocks")
    )
    joined = stored(texts.join(states, "uid", "left"), "joined", "zstd")
    drop_stored(alive)
    # Of the copies of a text one lends its strings.
    touched = joined.where("sure IS NOT NULL")
    open_texts = touched.where(F.size("blocks") > 0)
    head = open_texts.groupBy("uid").agg(F.min("order").alias("order"))
    open_texts = open_texts.join(head, ["uid", "order"])
    some = lambda far: _contexts(
        open_texts.select("uid", "text", F.filter("blocks", lambda x: x["far"] == far).alias("blocks")), length
    )
    found = _compare_near(some(False), length)
    if not wholes.where(F.col("kinds") > CROWD).isEmpty():
        found = found.union(_compare_far(some(True), length))
    drop_stored(kept)
    more = found.groupBy("uid").agg(F.collect_list("start").alias("starts"))
    rest = touched.join(more, "uid", "left").select("row", "text", "sure", "starts")
    return joined.where("sure IS NULL").select("row", "text"), rest


def _broken(data: bytes) -> np.ndarray:
    """Which bytes are no part of a valid UTF-8 character."""
    out = np.zeros(len(data), bool)

    def mark(error):
        out[error.start : error.end] = True
        return "", error.end

    try:
        data.decode()
    except UnicodeDecodeError:
        codecs.register_error("gridwash.broken", mark)
        data.decode(errors="gridwash.broken")
    return out


def _long_runs(gone: np.ndarray, data: np.ndarray, least_words: int) -> np.ndarray:
    """``gone`` without the runs that hold fewer than ``least_words`` whole words."""
    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    start, end = words.spans(data, np.array([0, len(data)]), words.SPACED)
    few = np.searchsorted(end, hi, "right") - np.searchsorted(start, lo) < least_words
    change = np.zeros(len(data) + 1, np.int32)
    change[lo[few]], change[hi[few]] = 1, -1
    return gone & (np.cumsum(change)[:-1] == 0)


def _covers(batch: pa.RecordBatch, length: int):
    """(text, which of its bytes a repeated string covers) of each row."""
    sure, single = batch.column(2), batch.column(3)
    texts = words.binary(batch.column(1))
    for r in range(batch.num_rows):
        data = np.frombuffer(texts[r].as_buffer(), np.uint8)
        edge = np.zeros(len(data) + 1, np.int32)
        spans = np.array(sure[r].as_py() or [], np.int64)
        alone = np.array(single[r].as_py() or [], np.int64)
        np.add.at(edge, np.concatenate([spans >> 32, alone]), 1)
        np.add.at(edge, np.concatenate([(spans & 0xFFFFFFFF), alone]) + length, -1)
        yield data, np.cumsum(edge)[:-1] > 0


def _run_lengths(gone: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    return np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)


def _measurer(length: int, least_words: int):
    def measure(batches):
        for batch in batches:
            passages, longest = [], []
            for data, gone in _covers(batch, length):
                runs = _run_lengths(gone)
                longest.append(int(runs.max(initial=0)))
                passages.append(len(_run_lengths(_long_runs(gone, data, least_words))) if len(runs) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(passages, pa.int64()), pa.array(longest, pa.int64())],
                ["row", "text", "n_passages", "longest"],
            )

    return measure


def _remover(length: int, whole_characters: bool = False, least_words: int = 0):
    def remove(batches):
        for batch in batches:
            out = []
            for data, gone in _covers(batch, length):
                if least_words and gone.any():
                    gone = _long_runs(gone, data, least_words)
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = data[~gone]
                if whole_characters and runs and (broken := _broken(kept.tobytes())).any():
                    # What was broken before the cuts is no part they leave over.
                    kept = kept[~broken | _broken(data.tobytes())[~gone]]
                out.append((len(data), int(gone.sum()), runs, kept.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([x[i] for x in out], kinds[i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], ["row", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return remove


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 400, least_words: int = 0) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; all columns and rows kept.

    Parts of characters that a cut leaves over go as well, so texts stay valid UTF-8.
    Bytes that were no characters before become U+FFFD. A null text stays null.
    """
    found = find_repeats(docs, text_col, length, whole_characters=True, least_words=least_words)
    whole = F.try_validate_utf8(F.col("kept").cast("string"))
    text = F.when(
        ~F.col("absent"), F.coalesce(whole, F.make_valid_utf8(F.col("kept").cast("string")))
    )
    return found.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
