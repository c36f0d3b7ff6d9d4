"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages. Every passage is encoded from its own bytes and words;
gated attention, learned from document labels only, weighs the encodings, and the
weighted sum is scored. The model is a few small matrices. It is trained on a bounded
sample of labelled rows, each with all its passages: in every round the tasks take steps
over their share of the bags, and the matrices are averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridwash.functions.cells import column
from gridwash.llm import words
from gridwash.llm.tables import stored

#: Bytes per passage; passages are cut in every text to its end.
PASSAGE = 1024
#: Bound of the training sample: labelled rows. All passages of their texts are learned from.
SAMPLE = 4000
#: Width of encodings and attention, passes over the sample, step size, weight decay.
WIDTH, ATTENTION, EPOCHS, RATE, DECAY = 24, 12, 30, 0.01, 1e-4
#: Rounds after which the tasks' models are averaged, tasks, and bags of a step.
ROUNDS, TASKS, STEP = 15, 8, 16

#: Fixed: kind of each byte. Lower, upper, digit, space, line end, marks of their own, other.
_KIND = np.full(256, 14, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
for _i, _marks in enumerate((b" \t", b"\n\r", b".", b",;:", b"!", b"?", b"|", b"#$%&*@^~", b"\"'`", b"-_/\\")):
    _KIND[list(_marks)] = 4 + _i
_EDGE = 15
FEATURES = 256 + 6


def encode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, offsets of the texts' passages) of one piece.

    Shares of the pairs of neighbouring byte kinds, share of word pairs that the text
    had before, share of words equal to the one before, word length, lengths of passage
    and text. An empty text is one empty passage.
    """
    size = np.diff(at)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(size)), size)
    passage = first[row] + (np.arange(len(data)) - at[row]) // PASSAGE
    kind = _KIND[data]
    after = np.full(len(data), _EDGE)
    after[:-1] = kind[1:]
    after[at[1:][size > 0] - 1] = _EDGE
    pairs = np.bincount(passage * 256 + kind * 16 + after, minlength=first[-1] * 256).reshape(-1, 256)
    length = pairs.sum(1)
    h, owner, starts, ends = words.hashed(data, at, words.SPACED)
    where = first[owner] + (starts - at[owner]) // PASSAGE
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    two = np.zeros(len(h), np.uint64)
    two[1:] = words.mix(h[1:] * np.uint64(31) + h[:-1])
    order = np.argsort(two)
    order = order[np.argsort(owner[order], kind="stable")]
    again = np.zeros(len(h), bool)
    if len(h):
        # Equal word pairs stand together; the one that comes first in the text is new.
        groups = np.ones(len(h), bool)
        groups[1:] = (two[order][1:] != two[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        again[order] = True
        again[np.minimum.reduceat(order, np.flatnonzero(groups))] = False
        again[np.flatnonzero(np.diff(owner, prepend=-1) != 0)] = False
    n = np.bincount(where, minlength=first[-1])
    share = lambda x: np.bincount(where, weights=x, minlength=first[-1]) / np.maximum(n, 1)
    text = np.repeat(size, count)
    more = [share(again), share(same), share(ends - starts) / 10, share(ends - starts <= 3), np.log1p(length) / 10, np.log1p(text) / 10]
    return np.hstack([np.sqrt(pairs / np.maximum(length, 1)[:, None]), np.stack(more, 1)]).astype(np.float32), first


def attend(model: dict, x: np.ndarray, bags: np.ndarray):
    """Forward pass over passages ``x`` in bags (offsets): (score, parts for training)."""
    x = (x - model["mean"]) / model["scale"]
    h = np.tanh(x @ model["W"] + model["b"])
    t, s = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    e = (t * s) @ model["w"]
    size = np.diff(bags)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, bags[:-1]), size))
    a = e / np.repeat(np.add.reduceat(e, bags[:-1]), size)
    z = np.add.reduceat(a[:, None] * h, bags[:-1])
    score = 1 / (1 + np.exp(-np.clip(z @ model["c"] + model["d"], -30, 30)))
    return score, (x, h, t, s, a, z, size)


LEARNED = ("W", "b", "V", "U", "w", "c", "d")


def first_model(mean: np.ndarray, scale: np.ndarray, ones: float, count: float, seed: int = 5) -> dict:
    """Small random matrices; the bias is the log odds of the labels."""
    rng = np.random.default_rng(seed)
    return {
        "mean": mean, "scale": scale,
        "W": rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), WIDTH)), "b": np.zeros(WIDTH),
        "V": rng.normal(0, 0.3, (WIDTH, ATTENTION)), "U": rng.normal(0, 0.3, (WIDTH, ATTENTION)),
        "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, WIDTH),
        "d": np.array(np.log((ones + 0.5) / (count - ones + 0.5))),
    }


def slopes(model: dict, x: np.ndarray, at: np.ndarray, label: np.ndarray) -> dict:
    """Slopes of the mean log loss of some bags (offsets) by the matrices."""
    score, (u, h, t, s, a, z, size) = attend(model, x, at)
    g = (score - label) / len(label)
    dz = np.repeat(g, size)[:, None] * model["c"]
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, at[:-1]), size))
    dt, ds = de[:, None] * model["w"] * s * (1 - t * t), de[:, None] * model["w"] * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ model["V"].T + ds @ model["U"].T) * (1 - h * h)
    return {"W": u.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": g.sum()}


class _Adam:
    def __init__(self, model: dict):
        self.one, self.two = ({k: np.zeros_like(model[k]) for k in LEARNED} for _ in range(2))
        self.step = 0

    def take(self, model: dict, slope: dict, rate: float) -> None:
        self.step += 1
        for k in LEARNED:
            grad = slope[k] + DECAY * model[k]
            self.one[k] = self.one[k] + 0.1 * (grad - self.one[k])
            self.two[k] = self.two[k] + 0.001 * (grad * grad - self.two[k])
            fast = self.one[k] / (1 - 0.9**self.step)
            model[k] = model[k] - rate * fast / (np.sqrt(self.two[k] / (1 - 0.999**self.step)) + 1e-8)


def fit(x: np.ndarray, bags: np.ndarray, label: np.ndarray, seed: int = 5) -> dict:
    """Train on passages ``x`` in bags with document labels (0, 1), in one place."""
    rng = np.random.default_rng(seed)
    model = first_model(x.mean(0), x.std(0) + 1e-3, label.sum(), len(label), seed)
    adam = _Adam(model)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        for some in np.array_split(order, max(1, len(label) // 64)):
            size = np.diff(bags)[some]
            at = np.concatenate([[0], np.cumsum(size)])
            pick = np.repeat(bags[some] - at[:-1], size) + np.arange(at[-1])
            adam.take(model, slopes(model, x[pick], at, label[some]), RATE * (1 - epoch / EPOCHS))
    return {k: np.asarray(v, np.float32) for k, v in model.items()}


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int, sample: int) -> DataFrame:
    """(_label, _text) of at most ``sample`` labelled rows outside the held fold, stored.

    The rows with the smallest hashes of their ids are taken: at most ``sample`` ids, so
    the side that is broadcast has a fixed bound. They are put into ``TASKS`` parts in an
    order of their own, the same in every run.
    """
    fold = F.crc32(column(id_col).cast("string").cast("binary")) % folds
    chosen = (
        labels.where(column(id_col).isNotNull() & column(label_col).isin(0, 1) & (fold != held))
        .groupBy(column(id_col).alias("_id")).agg(F.max(column(label_col)).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    texts = docs.select(column(id_col).alias("_id"), column(text_col).cast("binary").alias("_text"))
    texts = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max("_label").alias("_label"), F.max("_text").alias("_text"))
    part = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(TASKS)).cast("int").alias("_part")
    return stored(texts.select("_label", "_text", part, F.xxhash64("_id", F.lit(2)).alias("_order"), "_id"), "labelled")


def _bags(batches):
    """(passages, offsets of the bags, labels) of some whole texts, piece by piece."""
    for batch in batches:
        for lo, hi, data, at in words.pieces(batch.column(1)):
            x, first = encode(data, at)
            yield x, first, batch.column(0)[lo:hi].to_numpy().astype(np.float64)


def train(texts: DataFrame) -> dict | None:
    """The model after all rounds over labelled texts (None without any)."""

    def facts(batches):
        n, ones, count, total, square = 0, 0.0, 0, np.zeros(FEATURES), np.zeros(FEATURES)
        for x, _, label in _bags(batches):
            n, ones, count = n + len(x), ones + label.sum(), count + len(label)
            total += x.sum(0, dtype=np.float64)
            square += (x.astype(np.float64) ** 2).sum(0)
        yield _row(np.concatenate([[n, ones, count], total, square]), 0, 0)

    def learn(shared, rate):
        def run(batches):
            # A part is a share of its own, whatever tasks the parts fall into.
            model, adam, seen, part = None, None, 0, None
            for batch in batches:
                parts = batch.column(2).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
                for start, stop in zip(cuts[:-1], cuts[1:]):
                    if start < stop and parts[start] != part:
                        if seen:
                            yield _row(_flat(model), seen, part)
                        model, seen, part = dict(shared.value), 0, int(parts[start])
                        adam = _Adam(model)
                    for x, first, label in _bags([batch.slice(start, stop - start)]):
                        for lo in range(0, len(label), STEP):
                            hi = min(lo + STEP, len(label))
                            some = x[first[lo] : first[hi]]
                            adam.take(model, slopes(model, some, first[lo : hi + 1] - first[lo], label[lo:hi]), rate)
                            seen += hi - lo
            if seen:
                yield _row(_flat(model), seen, part)

        return run

    schema = "values binary, n long, part int"
    rows = texts.select("_label", "_text").mapInArrow(facts, schema).collect()
    sums = sum((np.frombuffer(r["values"], np.float64) for r in rows), np.zeros(3 + 2 * FEATURES))
    n, ones, count = sums[:3]
    if not count:
        return None
    mean = sums[3 : 3 + FEATURES] / n
    scale = np.sqrt(np.maximum(sums[3 + FEATURES :] / n - mean**2, 0)) + 1e-3
    model = first_model(mean, scale, ones, count)
    parts = texts.repartition(TASKS, "_part").sortWithinPartitions("_part", "_order", "_id").select("_label", "_text", "_part")
    sizes = np.cumsum([np.size(model[k]) for k in LEARNED])[:-1]
    for i in range(ROUNDS):
        shared = texts.sparkSession.sparkContext.broadcast(model)
        # One small row per part.
        rows = sorted(parts.mapInArrow(learn(shared, RATE * (1 - i / ROUNDS)), schema).collect(), key=lambda r: r["part"])
        total = sum(r["n"] * np.frombuffer(r["values"], np.float64) for r in rows) / sum(r["n"] for r in rows)
        model = model | {k: v.reshape(np.shape(model[k])) for k, v in zip(LEARNED, np.split(total, sizes))}
    return {k: np.asarray(v, np.float32) for k, v in model.items()}


def _flat(model: dict) -> np.ndarray:
    return np.concatenate([np.ravel(model[k]) for k in LEARNED])


def _row(values: np.ndarray, n: int, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([np.asarray(values, np.float64).tobytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([part], pa.int32())],
        ["values", "n", "part"],
    )


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 3,
    held: int = 1,
    sample: int = SAMPLE,
) -> DataFrame:
    """The rows of ``docs`` in a struct ``row``, with held_out, score, predicted.

    score (0 to 1): the model's probability of label 1; predicted: 1 from 0.5 on. Learns
    from all passages of at most ``sample`` labelled rows whose crc32(id as text) mod ``folds`` is not
    ``held``; every text is scored whole.

    Null and empty texts are one empty passage and get its score; labels that are null,
    not 0 or 1, or without an id are not learned from; of several labels of an id the
    larger counts, of several texts the one that is last in byte order; without any training row all scores are 0.5; repeated rows are each
    scored; an empty table gives no rows; columns may have any names.
    """
    model = train(training_texts(docs, labels, id_col, text_col, label_col, folds, held, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for lo, hi, data, at in words.pieces(batch.column(1)):
                value = np.full(hi - lo, 0.5)
                if shared.value is not None:
                    value = attend(shared.value, *encode(data, at))[0].astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(value)], ["row", "score"])

    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(text_col).cast("binary"))
    kind = rows.schema["row"].dataType.simpleString()
    fold = F.crc32(F.coalesce(F.col("row")[id_col].cast("string"), F.lit("")).cast("binary")) % folds
    return rows.mapInArrow(score, f"row {kind}, score double").select(
        "row", (fold == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that ``classify`` doesn't reject; all columns kept."""
    found = classify(docs, labels, **options).where("predicted = 1")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])
