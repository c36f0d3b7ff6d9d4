"""Exact quantiles of many columns by counting digits of their bits.

A double becomes a 64-bit whole number in the same order. A pass counts, for all columns
and ranks at once, how many values have each next digit (some leading bits), first inside
the tasks and then across them; the digit that holds a rank is the bracket of the next
pass. A digit whose values are all equal is done, so columns of few different or short
values take one or two passes, and the number of passes is bounded by 64 over the bits
of a digit, whatever the table. Only the digits that hold a wanted rank reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridwash.functions import cells

#: Bits of a digit (a window orders the digits of one bracket), and values that a task
#: gathers before it counts them.
_DIGIT = 22
_LIMIT = 1 << 22
_MASK = np.int64(0x7FFFFFFFFFFFFFFF)


def number(c):
    """A numeric column as double, NaN as null."""
    return cells.clean_number(c)


def _keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; -0.0 is 0.0."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _MASK, bits)


def _value(key: int) -> float:
    bits = np.array([key], np.int64)
    return float(np.where(bits < 0, bits ^ _MASK, bits).view(np.float64)[0])


def exact_quantiles(
    df: DataFrame, columns, probs=(0.25, 0.5, 0.75), limit: int = _LIMIT, digit: int = _DIGIT
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column; None for a column without values.

    At most 64 / ``digit`` passes; a task counts at most ``limit`` values (and a batch) at
    once. The result depends on neither.
    """
    columns, probs = list(columns), list(probs)
    if not columns or not probs:
        return {c: [] for c in columns}
    numbers = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    totals: dict[int, int] = {}
    found: dict[tuple[int, int], float] = {}
    # {(column, bracket): {rank inside the bracket: wanted ranks}}
    open_ = None
    shift = 64
    while open_ is None or open_:
        before, shift = shift, max(0, shift - digit)
        counted = _counted(numbers, before, shift, open_, limit)
        after: dict[tuple[int, int], dict[int, list]] = {}
        for r in _holding(counted, probs, open_):
            at, upto = (r["c"], r["bracket"]), r["below"] + r["n"]
            if open_ is None:
                totals[r["c"]] = r["total"]
                wanted = {rank: [rank] for rank in _ranks(r["total"], probs)}
            else:
                wanted = open_[at]
            for rank, ranks in wanted.items():
                if not r["below"] <= rank < upto:
                    continue
                if r["lo"] == r["hi"]:
                    found.update({(r["c"], k): _value(r["lo"]) for k in ranks})
                else:
                    inside = after.setdefault((r["c"], r["bucket"]), {})
                    inside.setdefault(rank - r["below"], []).extend(ranks)
        open_ = after
    return {
        c: _interpolate(totals[i], probs, {r: found[i, r] for r in _ranks(totals[i], probs)})
        if i in totals
        else [None] * len(probs)
        for i, c in enumerate(columns)
    }


def _ranks(n: int, probs) -> list[int]:
    return sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)})


def _interpolate(n: int, probs, found: dict[int, float]) -> list[float]:
    out = []
    for p in probs:
        pos = p * (n - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        a, b = found[lo], found[hi]
        out.append(a if a == b else (hi - pos) * a + (pos - lo) * b)
    return out


def _counted(numbers: DataFrame, before: int, shift: int, open_: dict | None, limit: int) -> DataFrame:
    """(c, bracket, bucket, n, lo, hi): values with each digit in the open brackets.

    A bracket is the bits above ``before``, a bucket those above ``shift``.
    """
    count = len(numbers.columns)
    brackets = None if open_ is None else [
        np.array(sorted(b for c, b in open_ if c == i), np.int64) for i in range(count)
    ]

    def digits(i: int, keys: np.ndarray):
        keys = np.sort(keys)
        bucket = keys >> shift
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        last = np.append(first[1:], len(keys)) - 1
        bracket = np.zeros(len(first), np.int64) if before == 64 else keys[first] >> before
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(first), i, np.int32)), pa.array(bracket), pa.array(bucket[first]),
                pa.array(last - first + 1), pa.array(keys[first]), pa.array(keys[last]),
            ],
            ["c", "bracket", "bucket", "n", "lo", "hi"],
        )

    def tally(batches):
        held, size = [[] for _ in range(count)], 0
        for batch in batches:
            for i in range(count):
                values = batch.column(i).to_numpy(zero_copy_only=False)
                keys = _keys(values[~np.isnan(values)])
                if brackets is not None:
                    keys = keys[np.isin(keys >> before, brackets[i])] if len(brackets[i]) else keys[:0]
                held[i].append(keys)
                size += len(keys)
            if size > limit:
                yield from (digits(i, keys) for i, x in enumerate(held) if len(keys := np.concatenate(x)))
                held, size = [[] for _ in range(count)], 0
        yield from (digits(i, keys) for i, x in enumerate(held) if x and len(keys := np.concatenate(x)))

    rows = numbers.mapInArrow(tally, "c int, bracket long, bucket long, n long, lo long, hi long")
    return rows.groupBy("c", "bracket", "bucket").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def _holding(counted: DataFrame, probs, open_: dict | None) -> list:
    """The buckets that hold a wanted rank, with the values below them in their bracket.

    A window orders the buckets of one bracket, at most 2**digit of them.
    """
    bracket = Window.partitionBy("c", "bracket")
    placed = counted.select(
        "*",
        (F.sum("n").over(bracket.orderBy("bucket")) - F.col("n")).alias("below"),
        F.sum("n").over(bracket).alias("total"),
    )
    if open_ is None:
        place = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
        ranks = F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)])
    else:
        key = F.concat_ws(":", "c", "bracket")
        pairs = [(F.lit(f"{c}:{b}"), F.array(*[F.lit(r).cast("long") for r in wanted])) for (c, b), wanted in open_.items()]
        ranks = F.create_map(*[x for pair in pairs for x in pair])[key]
    below, upto = F.col("below"), F.col("below") + F.col("n")
    return placed.where(F.exists(ranks, lambda r: (r >= below) & (r < upto))).collect()
