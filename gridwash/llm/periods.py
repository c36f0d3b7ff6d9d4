"""Periodic runs of words by a dictionary of basic factors.

The words of a text are numbered by what they are; the factor of 2**k words at a place
gets a number from the pair of half factors it is made of. The successor of a place is
the next one with the same factor. In a stretch of smallest period q, with 2**k the
first power of two that is not below q, the successor of every place is exactly q
further, and next to the stretch it is not: consecutive places whose successors are all
q further (an arithmetic progression with as many terms as the stretch has periods) are
one run, from the first place to the end of the last place's successor. So a level
proposes the periods in (2**(k-1), 2**k], each run is found at one level only, and its
ends need no further extension.

Factors that occur once in a text hold no run, and neither do longer ones that contain
them; they leave the dictionary, so few are left after some levels of natural text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridwash.functions.cells import column
from gridwash.llm import words

#: A run holds at least so many words, and so many of its periods.
LEAST, TIMES = 6, 4


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dense numbers, order that sorts by value and then place)."""
    order = np.argsort(values, kind="stable")
    sorted_ = values[order]
    new = np.ones(len(values), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order


def find_runs(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run in rows of words, by start and then period.

    ``names`` are numbers of the words of all rows, equal for equal words; row r holds
    the places bounds[r] to bounds[r + 1]. Starts count over all rows.
    """
    total = len(names)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # Equal words of different rows are different factors.
    name, order = _grouped(row * (int(names.max(initial=0)) + 1) + names)
    place, found = np.arange(total), []
    longest = int(np.diff(bounds).max(initial=0))
    size = 1
    while len(place):
        following = order[1:][name[order[1:]] == name[order[:-1]]]
        leading = order[:-1][name[order[1:]] == name[order[:-1]]]
        distance = np.zeros(len(place), np.int64)
        distance[leading] = place[following] - place[leading]
        near = np.flatnonzero((2 * distance > size) & (distance <= size))
        if len(near):
            at, period = place[near], distance[near]
            first = np.ones(len(near), bool)
            first[1:] = (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])
            heads = np.flatnonzero(first)
            count = np.diff(np.append(heads, len(near)))
            length = count - 1 + size + period[heads]
            long = length >= np.maximum(LEAST, TIMES * period[heads])
            found.append(np.stack([at[heads], length, period[heads]], 1)[long])
        # The period of a run at the next level is above this size.
        if TIMES * (size + 1) > longest:
            break
        repeated = np.zeros(len(place), bool)
        repeated[leading] = repeated[following] = True
        number = np.full(total + size, -1, np.int64)
        number[place[repeated]] = name[repeated]
        left = place[repeated]
        left = left[left + size < total]
        left = left[(number[left + size] >= 0) & (row[left] == row[left + size])]
        name, order = _grouped(number[left] * total + number[left + size])
        place, size = left, 2 * size
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(n: int, doc_id: int) -> np.ndarray:
    """Which original word stands at each of ``n`` places: of one document in ten the
    words from a place on repeat."""
    mark = zlib.crc32(str(doc_id).encode())
    source = np.arange(n)
    if mark % 10 == 0 and n:
        g = mark // 10
        a = g % n
        source[a:] = a + (source[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return source


def _kept_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray):
    """The words [start, end) of each row joined by one space, as bytes."""
    size = end - start + 1
    stop = np.cumsum(size)
    index = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - size), size)
    blank = np.zeros(len(index), bool)
    blank[stop - 1] = True
    index[blank] = 0
    joined = data[index] if len(index) else np.zeros(0, np.uint8)
    joined[blank] = 32
    at = np.concatenate([[0], stop])[bounds]
    for lo, hi in zip(at[:-1], at[1:]):
        yield joined[lo : max(lo, hi - 1)].tobytes()


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False
) -> DataFrame:
    """(row, n_words, runs, collapsed) of every row of ``docs``.

    ``row`` holds all columns but the text. ``runs`` are the maximal stretches of words
    (split at white space) with a smallest period q and at least max(6, 4 * q) words:
    structs of start, length, period, by start and then period. ``collapsed`` is the text
    without the words that a run repeats: those that it holds after its first q, the
    others joined by one space, as bytes. With ``plant`` the words of one document in ten
    are made to repeat first (``planted``); documents without an id are left as they are.

    A null, empty or blank text has no words, no runs and an empty collapsed text; texts
    are whole and never compared with each other; rows of equal ids or texts are kept;
    an empty table gives no rows; columns may have any names.
    """
    others = [column(c) for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.struct(*others).alias("row"), column(id_col).cast("long").alias("id"), column(text_col).cast("binary").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def collapse(batches):
        for batch in batches:
            for r0, r1, data, at in words.pieces(batch.column(2)):
                start, end = words.spans(data, at, words.SPACED)
                bounds = np.searchsorted(start, at)
                if plant:
                    source = [
                        lo + (planted(hi - lo, i) if i is not None else np.arange(hi - lo))
                        for lo, hi, i in zip(bounds[:-1], bounds[1:], batch.column(1)[r0:r1].to_pylist())
                    ]
                    source = np.concatenate(source)
                    start, end = start[source], end[source]
                yield _collapsed(batch.column(0)[r0:r1], data, start, end, bounds)

    run = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return rows.mapInArrow(collapse, f"row {kind}, n_words long, runs {run}, collapsed binary")


def _collapsed(row, data, start, end, bounds) -> pa.RecordBatch:
    size = end - start
    # Words are numbered by their bytes, not by a hash.
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[index]))]
    column_ = pa.Array.from_buffers(pa.large_binary(), len(size), buffers)
    names = column_.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = find_runs(names, bounds)
    edge = np.zeros(len(size) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edge)[:-1] == 0
    before = np.concatenate([[0], np.cumsum(kept)])
    texts = list(_kept_texts(data, start[kept], end[kept], before[bounds]))
    own = np.searchsorted(runs[:, 0], bounds)
    first = np.repeat(bounds[:-1], np.diff(own))
    struct = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - first), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"]
    )
    return pa.RecordBatch.from_arrays(
        [row, pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(own, pa.int32()), struct), pa.array(texts, pa.binary())],
        ["row", "n_words", "runs", "collapsed"],
    )


#: DuckDB: all pairs of equal words within a quarter of the text, per period their islands.
ORACLE_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(str_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
               lambda crc, byte: list_reduce(
                   list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                   lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
    FROM documents
), sizes AS (
    SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g FROM texts
), planted AS (
    SELECT doc_id, ws, n, CASE WHEN n > 0 AND h % 10 = 0 THEN g % n ELSE n END AS a, g FROM sizes
), placed AS (
    SELECT doc_id, n, i, CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END AS word
    FROM planted, unnest(range(n)) AS r(i)
), pairs AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q
    FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
    SELECT doc_id, q, min(i) AS s, count(*) + q AS len
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
    GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
    SELECT * FROM islands a WHERE NOT EXISTS (
        SELECT 1 FROM islands b WHERE b.doc_id = a.doc_id AND b.q < a.q AND b.s <= a.s AND b.s + b.len >= a.s + a.len)
), facts AS (
    SELECT doc_id, count(*) AS n_runs, max(struct_pack(l := len, s := -s, q := -q)) AS best,
           string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed
    FROM runs GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM placed p WHERE NOT EXISTS (
        SELECT 1 FROM runs r WHERE r.doc_id = p.doc_id AND p.i >= r.s + r.q AND p.i < r.s + r.len)
    GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS "start", best.l AS length, -best.q AS period,
       1000 * best.l // -best.q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN facts f ON f.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
