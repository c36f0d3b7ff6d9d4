"""Document fingerprints from prefix polynomial hashes.

A text's code points c are hashed by running sums of (c + 1) * base**i modulo two primes
of 31 bits. The difference of two sums, shifted back by a power of the inverse base, is
the hash of the span between them, so any two spans of any texts are compared by a few
multiplications, and the longest common extension of two places is found by binary
search over its length.

A fingerprint is a text of five parts: the number of code points, the hash of all of
them, hashes of the prefixes and of the suffixes at multiples of a step that is a power
of two (up to 32 of each), and the smallest hashes of the spans of 16 code points. Two
fingerprints tell, by binary search over the shared multiples, how far the texts agree
from both ends, and by the smallest hashes how many spans they share anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridwash.functions.cells import column
from gridwash.llm import words

U64 = np.uint64
#: Fixed for all executors: primes of 31 bits and a base of each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525177)
#: Most prefixes (and suffixes) in a fingerprint, a power of two; code points of a span;
#: smallest span hashes kept.
STEPS, WIDTH, SKETCH = 32, 16, 16
#: Code points summed at once.
CHUNK = 1 << 20
#: Bytes of text per ordered part, and parts at most (their heads are broadcast).
PART, PARTS = 1 << 25, 20_000


class _Powers:
    """Powers of the bases and of their inverses, grown by doubling."""

    def __init__(self):
        self.up = [np.ones(1, np.uint32) for _ in PRIMES]
        self.down = [np.ones(1, np.uint32) for _ in PRIMES]

    def upto(self, n: int) -> None:
        for which, prime in enumerate(PRIMES):
            for table, base in ((self.up, BASES[which]), (self.down, pow(BASES[which], -1, prime))):
                have = table[which]
                while len(have) <= n:
                    step = U64(pow(base, len(have), prime))
                    have = np.concatenate([have, (have * step % U64(prime)).astype(np.uint32)])
                table[which] = have


_POWERS = _Powers()


class Prefixes:
    """Modular prefix arrays of one text; hashes of its spans in constant time each."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.n = len(self.codes)
        _POWERS.upto(self.n)
        self.sums = []
        for which, prime in enumerate(PRIMES):
            sums, last = np.zeros(self.n + 1, np.uint32), 0
            for lo in range(0, self.n, CHUNK):
                terms = (self.codes[lo : lo + CHUNK] + np.uint32(1)).astype(U64)
                terms *= _POWERS.up[which][lo : lo + len(terms)]
                terms %= U64(prime)
                terms[0] += U64(last)
                sums[lo + 1 : lo + 1 + len(terms)] = np.cumsum(terms, dtype=U64) % U64(prime)
                last = int(sums[lo + len(terms)])
            self.sums.append(sums)
        self._values = None

    def followed_by(self, keep: int, other: Prefixes, take: int) -> Prefixes:
        """The first ``keep`` code points and then the first ``take`` of ``other``: its
        sums are shifted behind these, nothing is summed again."""
        out = object.__new__(Prefixes)
        out.n = keep + take
        _POWERS.upto(out.n)
        out.codes = np.concatenate([self.codes[:keep], other.codes[:take]])
        out.sums = []
        for which, prime in enumerate(PRIMES):
            tail = other.sums[which][1 : take + 1].astype(U64)
            tail *= U64(_POWERS.up[which][keep])
            tail += U64(self.sums[which][keep])
            tail %= U64(prime)
            out.sums.append(np.concatenate([self.sums[which][: keep + 1], tail.astype(np.uint32)]))
        # Spans that lie in the kept part have the same hashes.
        same = max(0, keep - WIDTH + 1) if out.n >= WIDTH else 0
        out._values = np.concatenate([self.values()[:same], out._mixed(same)])
        return out

    def span(self, start, end, which: int | None = None):
        """Hash of the code points [start, end): 62 bits, or 31 of one prime."""
        if which is None:
            return self.span(start, end, 0) << U64(31) | self.span(start, end, 1)
        prime = U64(PRIMES[which])
        own = self.sums[which][end].astype(U64) + prime - self.sums[which][start]
        return own * _POWERS.down[which][start] % prime

    def same(self, start, end, other: Prefixes, there):
        """Whether the spans equal the spans of ``other`` that start ``there``."""
        return self.span(start, end) == other.span(there, there + (end - start))

    def extension(self, start, other: Prefixes, there, back: bool = False) -> np.ndarray:
        """Length of the longest common extension of each pair of places, by binary
        search; with ``back`` of what stands before them."""
        start, there = np.atleast_1d(np.asarray(start, np.int64)), np.atleast_1d(np.asarray(there, np.int64))
        low = np.zeros(np.broadcast(start, there).shape, np.int64)
        high = np.minimum(start, there) if back else np.minimum(self.n - start, other.n - there)
        while (low < high).any():
            middle = (low + high + 1) // 2
            shift = middle if back else 0
            equal = self.same(start - shift, start - shift + middle, other, there - shift)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def ends(self, other: Prefixes) -> tuple[int, int]:
        """Code points that two texts share from their starts and up to their ends."""
        most = min(self.n, other.n)
        if not most:
            return 0, 0
        # Most texts differ at once.
        prefix = self.codes[0] == other.codes[0] and int(self.extension(0, other, 0)[0])
        suffix = self.codes[-1] == other.codes[-1] and int(self.extension(self.n, other, other.n, back=True)[0])
        return int(prefix), int(suffix)

    def _mixed(self, lo: int, hi: int | None = None) -> np.ndarray:
        """Mixed hashes of the spans of WIDTH code points from ``lo`` on, 32 bits each; a
        shorter text is one span."""
        spans = max(1, self.n - WIDTH + 1) if self.n else 0
        at = np.arange(lo, spans if hi is None else min(hi, spans))
        return (words.mix(self.span(at, np.minimum(at + WIDTH, self.n), 0)) >> U64(32)).astype(np.uint32)

    def values(self) -> np.ndarray:
        if self._values is None:
            parts = [self._mixed(lo, lo + CHUNK) for lo in range(0, max(1, self.n), CHUNK)]
            self._values = np.concatenate(parts)
        return self._values

    def smallest(self) -> np.ndarray:
        """The SKETCH smallest distinct mixed hashes of the spans of WIDTH code points."""
        value = self.values()
        if len(value) > 16 * SKETCH:
            few = np.unique(np.partition(value, 4 * SKETCH)[: 4 * SKETCH])
            # Spans that occur often may leave too few different ones.
            value = few if len(few) >= SKETCH else value
        return np.unique(value)[:SKETCH]


def step(n: int) -> int:
    """Distance of the prefixes in the fingerprint of a text of ``n`` code points."""
    return 1 << max(0, (-(-n // STEPS) - 1).bit_length())


def _digits(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def fingerprint(text: Prefixes) -> str:
    """``n.whole.prefixes.suffixes.smallest`` in decimal and hexadecimal digits."""
    n = text.n
    at = np.arange(step(n), n + 1, step(n))
    whole = int(text.span(np.int64(0), np.int64(n)))
    prefixes = text.span(np.zeros_like(at), at, 0)
    suffixes = text.span(n - at, np.full_like(at, n), 0)
    return f"{n}.{whole:016x}.{_digits(prefixes)}.{_digits(suffixes)}.{_digits(text.smallest())}"


def _agreement(a: str, b: str, steps: tuple[int, int], most: int) -> int:
    """Longest shared prefix (or suffix) that two rows of hashes show, a multiple of the
    larger step: if one agrees, all shorter ones do, so binary search finds it."""
    wide = max(steps)
    low, high = 0, most // wide
    while low < high:
        middle = (low + high + 1) // 2
        i, j = (8 * (middle * wide // own - 1) for own in steps)
        if a[i : i + 8] == b[j : j + 8]:
            low = middle
        else:
            high = middle - 1
    return low * wide


def likeness(a: str, b: str) -> float:
    """Share of the longer text that two fingerprints show to be common, from 0 to 1.

    The larger of two estimates: what agrees from both ends, and twice the shared spans
    over all spans of both. 1 only for equal fingerprints, 0 if one text is empty.
    """
    if a == b:
        return 1.0
    (n, _, *left), (m, _, *right) = a.split("."), b.split(".")
    n, m = int(n), int(m)
    if not n or not m:
        return 0.0
    steps, short = (step(n), step(m)), min(n, m)
    ends = min(short, sum(_agreement(left[i], right[i], steps, short) for i in range(2)))
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (left[2], right[2]))
    union = sorted(x | y)[:SKETCH]
    shared = sum(v in x and v in y for v in union) / len(union)
    return min(max(ends / max(n, m), 2 * shared / (1 + shared)), 1 - 1 / (2 * max(n, m)))


def _text(value) -> str:
    return value.as_py().decode(errors="replace")


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """(row, ``name``): all columns of ``docs`` as a struct, and the text's fingerprint.

    A null text counts as empty; bytes that are no characters count as U+FFFD; equal
    texts get equal fingerprints; repeated rows stay; an empty table gives no rows.
    """

    def mark(batches):
        for batch in batches:
            marks = [fingerprint(Prefixes(_text(t))) for t in words.binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], ["row", name])

    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(mark, f"row {rows.schema['row'].dataType.simpleString()}, {name} string")


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, part, ahead): documents by descending id within parts, one text shuffled
    once; the first of the next part follows each part as a row that is ``ahead``."""
    text = F.coalesce(column(text_col).cast("binary"), F.lit(b""))
    id_ = column(id_col).cast("long")
    rows = docs.select(
        id_.isNotNull().alias("known"), F.coalesce(id_, F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = int(min(PARTS, max(4 * tasks, total // PART)))
    shares = [i / count for i in range(1, count)]
    bounds = rows.where("known").agg(F.percentile_approx("id", shares, 10 * count)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))

    @F.arrow_udf("int")
    def part_of(ids: pa.Array, known: pa.Array) -> pa.Array:
        place = len(bounds) - np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False))
        place[~known.to_numpy(zero_copy_only=False)] = len(bounds) + 1
        return pa.array(place, pa.int32())

    keys = ["known", "id", "hash"]
    placed = rows.withColumn("part", part_of("id", "known"))
    heads = placed.groupBy("part").agg(F.max(F.struct(*keys)).alias("head")).orderBy("part").collect()
    before = [heads[i - 1]["part"] for i in range(len(heads))]
    guards = docs.sparkSession.createDataFrame(
        [(*r["head"], p) for r, p in zip(heads, before)], "known boolean, id long, hash long, guarded int"
    )
    # Two rows at most per part, of which there are at most PARTS.
    both = placed.join(F.broadcast(guards), keys, "left")
    place = lambda part, ahead: F.struct(part.alias("part"), F.lit(ahead).alias("ahead"))
    own, copy = place(F.col("part"), False), place(F.col("guarded"), True)
    both = both.withColumn("place", F.explode(F.when(F.col("guarded").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    both = both.select(F.when(F.col("known"), F.col("id")).alias("id"), "hash", "text", "place.part", "place.ahead")
    return both.repartition("part").sortWithinPartitions(
        "part", "ahead", F.desc_nulls_last("id"), F.desc("hash")
    ).select("id", "text", "part", "ahead")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, compared.

    The last third of the code points (rounded down) is replaced by the first as many of
    the next document (or all it has), by descending id; after the last comes the first.
    Columns: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next; next_id; common_prefix and common_suffix: code points that the text and
    the next one share from their starts and up to their ends (longest common
    extensions).

    Ids are whole numbers. Rows without an id come last, rows of equal ids are ordered by
    a hash of the text, so copies that share an id as well stand together in one part;
    a null text counts as empty; bytes that are no characters count as U+FFFD; an only
    document is its own next; an empty table gives no rows; other columns are ignored.
    """
    names = [
        "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        "next_id", "common_prefix", "common_suffix",
    ]
    kinds = [
        pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(),
        pa.int64(), pa.int64(), pa.int64(),
    ]

    def compare(one, two) -> tuple:
        (id_, text, prefixes, mark), (next_id, other, ahead, next_mark) = one, two
        n = len(text)
        edited = text[: n - n // 3] + other[: n // 3]
        changed = mark
        if edited != text:
            changed = fingerprint(prefixes.followed_by(n - n // 3, ahead, min(n // 3, ahead.n)))
        return (
            id_, n, hashlib.sha256(edited.encode()).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, next_mark),
            next_id, *prefixes.ends(ahead),
        )

    def walk(batches):
        held = part = None
        for batch in batches:
            rows = []
            ids, parts, ahead = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for i, value in enumerate(words.binary(batch.column(1))):
                if parts[i] != part:
                    held, part = None, parts[i]
                elif held is None:
                    continue  # a further copy of the row ahead
                text = _text(value)
                prefixes = Prefixes(text)
                one = (ids[i], text, prefixes, fingerprint(prefixes))
                if held is not None:
                    rows.append(compare(held, one))
                held = None if ahead[i] else one
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    schema = (
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, next_id long, common_prefix long, common_suffix long"
    )
    return _ordered(docs, id_col, text_col).mapInArrow(walk, schema).withColumnRenamed("id", id_col)
