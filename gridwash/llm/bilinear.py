"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Every token is a symbol: one of the frequent training words (their number is the square
root of all distinct ones), the end of a text, or one of ``CLASSES`` classes of all other
words by their last two bytes. The vectors of the two symbols before a token, and the sum
of those of the ``FAR`` before these, each with weights of its own, add up to its
prediction; the vectors of groups, and of the symbols
within a group, are compared with it. So a symbol's probability is that of its group times
its own within the group, both sum to one, and the cost grows with the root of the
symbols. A word of a class then has its share of the class by smoothed training counts,
so the probabilities of all words sum to one.

Training runs in the tasks, over all training texts: in every round each task takes noise
contrastive steps over its share of a slice of them, and the vectors of all tasks are
averaged, first across the cluster and then on the driver. Word counts and class totals
cover all training texts as well. Only tables of a bounded size reach the driver: the head
of the word list (at most ``HEAD`` words) and the vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridwash.functions.cells import column
from gridwash.llm import words
from gridwash.llm.tables import stored

#: Word symbols at most, classes, and symbols of context behind the two next to a token.
MOST, CLASSES, FAR = 4095 - 256, 256, 30
#: Most words whose counts are sent to all tasks; the counts of all others are joined.
HEAD = 1 << 18
#: Distinct words a task holds while counting before it passes them on.
HELD = 1 << 20
#: The model: dimensions, noise words per word, tokens of a step, size of the first steps.
DIMENSIONS, NOISE, STEP, RATE = 16, 25, 8192, 0.02
#: Tokens that are scored at once.
TOGETHER = 1 << 14
#: Slices of the texts by round, in 64ths; tokens that training passes over, at least.
SLICES, LEAST = (2, 2, 4, 8, 16, 32), 8_000_000


def _classes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    last = mapped[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, mapped[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    return (words.mix(last * np.uint64(256) + before) % np.uint64(CLASSES)).astype(np.int32)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, class, c) over all texts (one column); words are 64-bit hashes."""

    def merged(held):
        h, cls, c = (np.concatenate(x) for x in zip(*held))
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return h, cls[first], np.bincount(inverse, weights=c).astype(np.int64)

    def batch_of(h, cls, c):
        return pa.RecordBatch.from_arrays(
            [pa.array(words.signed(h)), pa.array(cls), pa.array(c)], ["word", "class", "c"]
        )

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, data, at in words.pieces(batch.column(0)):
                h, _, starts, ends = words.hashed(data, at, words.SPACED)
                cls = _classes(words.LOWER[data], starts, ends)
                h, first, c = np.unique(h, return_index=True, return_counts=True)
                held.append((h, cls[first], c))
                size += len(h)
                if size > HELD:
                    held = [merged(held)]
                    if (size := len(held[0][0])) > HELD // 2:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*merged(held))

    rows = texts.mapInArrow(count, "word long, class int, c long")
    return rows.groupBy("word").agg(F.max("class").alias("class"), F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int):
    """(words, classes, counts, least count): all words above a count, at most ``most``.

    The count comes from a histogram over eighths of powers of two.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(step).count().collect()), reverse=True)
    total, floor = 0, None
    for s, n in steps:
        if total + n > most:
            break
        total, floor = total + n, s
    rows = counts.where(step >= floor).collect() if floor is not None else []
    table = np.array([(r["word"], r["class"], r["c"]) for r in rows], np.int64).reshape(-1, 3)
    table = table[np.argsort(table[:, 0].view(np.uint64))]
    return table[:, 0].copy().view(np.uint64), table[:, 1].astype(np.int32), table[:, 2].copy(), floor


def read_texts(docs: DataFrame, head_words, symbols, logs, end: int) -> DataFrame:
    """(id, held_out, n_tokens, head_log, symbols, rare, times) per text.

    symbols: the symbol of each token, two bytes each; rare: the distinct words outside
    the head; head_log: sum of log10(c + 0.5) over the words of the head that classes hold,
    and over all of the head.
    """
    shared = docs.sparkSession.sparkContext.broadcast((head_words, symbols, logs))

    def read(batches):
        head, symbol, log = shared.value
        for batch in batches:
            for lo, hi, data, at in words.pieces(batch.column(2)):
                rows = hi - lo
                h, row, starts, ends = words.hashed(data, at, words.SPACED)
                cls = _classes(words.LOWER[data], starts, ends)
                if len(head):
                    i = np.minimum(np.searchsorted(head, h), len(head) - 1)
                    known = head[i] == h
                    own = np.where(known, symbol[i], end + 1 + cls)
                    value = np.where(known, log[i], 0.0)
                else:
                    known, own, value = np.zeros(len(h), bool), end + 1 + cls, np.zeros(len(h))
                bounds = words.word_bounds(row, rows)
                n = np.diff(bounds)
                # The end of each text goes behind its words.
                stream = np.full(len(h) + rows, end, np.uint16)
                stream[np.arange(len(h)) + row] = own
                ends_at = (bounds + np.arange(rows + 1)) * 2
                all_log = np.bincount(row, weights=value, minlength=rows)
                class_log = np.bincount(row, weights=np.where(own > end, value, 0.0), minlength=rows)
                head_n = np.bincount(row, weights=known, minlength=rows).astype(np.int64)
                rare, rare_row = h[~known], row[~known]
                order = np.lexsort((rare, rare_row))
                rare, rare_row = rare[order], rare_row[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(rare))).astype(np.int32)
                cut = np.searchsorted(rare_row[heads], np.arange(rows + 1))
                raw = pa.py_buffer(stream.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(n + 1), pa.array(head_n),
                        pa.array(all_log), pa.array(class_log),
                        pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends_at.astype(np.int32).tobytes()), raw]),
                        words.lists(words.signed(rare[heads]), cut), words.lists(times, cut),
                    ],
                    ["id", "held_out", "n_tokens", "head_n", "all_log", "class_log", "symbols", "rare", "times"],
                )

    return docs.mapInArrow(
        read,
        "id long, held_out boolean, n_tokens long, head_n long, all_log double, class_log double, "
        "symbols binary, rare array<long>, times array<int>",
    )


class Shape:
    """How many symbols there are, and how they are put into groups."""

    def __init__(self, word_symbols: int):
        self.end = word_symbols
        self.symbols = word_symbols + 1 + CLASSES
        self.groups = math.isqrt(self.symbols - 1) + 1
        self.most = -(-self.symbols // self.groups)

    def place(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, member) of symbols: neighbours, which are about as frequent, part."""
        return symbol % self.groups, symbol // self.groups

    def members(self, group: int) -> int:
        return len(range(group, self.symbols, self.groups))


def first_model(shape: Shape, counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random vectors; biases are the logs of the smoothed shares of the counts."""
    rng = np.random.default_rng(seed)
    q = (counts + 0.5) / (counts.sum() + 0.5 * len(counts))
    of_group = np.bincount(np.arange(shape.symbols) % shape.groups, weights=q)
    own = q / of_group[np.arange(shape.symbols) % shape.groups]
    vectors = lambda n: rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)
    return {
        "context": vectors(shape.symbols), "weight": np.full((3, DIMENSIONS), 1 / 3, np.float32),
        "group": vectors(shape.groups), "group_bias": np.log(of_group).astype(np.float32),
        "member": vectors(shape.symbols), "member_bias": np.log(own).astype(np.float32),
        "group_noise": np.log(NOISE * of_group).astype(np.float32), "member_noise": np.log(NOISE * own).astype(np.float32),
    }


LEARNED = ("context", "weight", "group", "group_bias", "member", "member_bias")


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns before each column and before the end."""
    out = np.zeros((len(x), x.shape[1] + 1))
    np.cumsum(x, axis=1, out=out[:, 1:])
    return out


def contexts(model: dict, symbol: np.ndarray, place: np.ndarray, end: int) -> list[np.ndarray]:
    """Before each token: the vectors of the last symbol, the one before it, and the sum
    of those of the ``FAR`` before these, divided by their number. A column is a token.

    ``place`` counts the tokens of a text from 0; texts stand one behind the other. Where
    no symbol is left stands the end, and nothing in the sum.
    """
    table = np.ascontiguousarray(model["context"].T)
    own = np.take(table, symbol, axis=1)
    at = np.arange(len(symbol))
    near = []
    for j in (1, 2):
        moved = np.empty_like(own)
        moved[:, j:] = own[:, : len(symbol) - j]
        moved[:, np.flatnonzero((place < j) | (at < j))] = table[:, end, None]
        near.append(moved)
    start, total = np.maximum(at - place, 0), _sums(own)
    far = np.take(total, np.maximum(at - 2, start), axis=1)
    far -= np.take(total, np.maximum(at - 2 - FAR, start), axis=1)
    far /= FAR
    return [*near, far.astype(own.dtype)]


def predictions(model: dict, context: list[np.ndarray]) -> np.ndarray:
    """The weighed sum of a token's contexts; a row is a token."""
    out = model["weight"][0][:, None] * context[0]
    for w, x in zip(model["weight"][1:], context[1:]):
        out += w[:, None] * x
    return np.ascontiguousarray(out.T)


def _spread(model: dict, context, dq: np.ndarray, symbol: np.ndarray, place: np.ndarray, end: int):
    """Slopes by the weights and by the vectors of the symbols, from those by the predictions."""
    n, at = len(symbol), np.arange(len(symbol))
    weight = np.stack([np.einsum("ij,ij->i", dq, x) for x in context])
    # A token is in the sum of those from three places on to the end of the window or text.
    heads = np.append(np.flatnonzero((place == 0) & (at > 0)), n)
    stop = heads[np.searchsorted(heads, at, "right")]
    total = _sums(dq)
    back = np.take(total, np.minimum(at + 3 + FAR, stop), axis=1)
    back -= np.take(total, np.minimum(at + 3, stop), axis=1)
    back *= (model["weight"][2] / FAR)[:, None]
    ends = np.zeros(len(dq))
    for j, w in zip((1, 2), model["weight"]):
        none = np.flatnonzero((place < j) | (at < j))
        given = w[:, None] * dq
        ends += given[:, none].sum(1)
        given[:, none] = 0
        back[:, : max(0, n - j)] += given[:, j:]
    out = np.stack([np.bincount(symbol, weights=row, minlength=len(model["context"])) for row in back], 1)
    out[end] += ends
    return weight, out.astype(model["context"].dtype)


def _by_group(group: np.ndarray, groups: int):
    """(group, places of its tokens) of the groups that occur."""
    order = np.argsort(group.astype(np.uint16), kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(bounds)):
        yield int(g), order[bounds[g] : bounds[g + 1]]


def _slope(score, noise, target):
    """Slopes of the contrastive loss by the scores (a column is a token): each of the
    ``NOISE`` noise symbols is expected in full; a score is set against the log of its noise."""
    np.subtract(noise[:, None], score, out=score)
    np.clip(score, -30, 30, out=score)
    np.exp(score, out=score)
    score += 1
    at = np.arange(len(target))
    slope = np.exp(noise)[:, None] / score
    slope[target, at] -= 1 - 1 / score[target, at]
    return slope


def slopes(model: dict, shape: Shape, symbol: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """Mean slopes of the loss over some tokens, by the parameters."""
    context = contexts(model, symbol, place, shape.end)
    q = predictions(model, context)
    group, member = shape.place(symbol)
    out = {k: np.zeros_like(model[k]) for k in LEARNED}
    first = _slope(model["group"] @ q.T + model["group_bias"][:, None], model["group_noise"], group)
    out["group"], out["group_bias"] = first @ q, first.sum(1)
    dq = model["group"].T @ first
    for g, some in _by_group(group, shape.groups):
        own = slice(g, None, shape.groups)
        near = q[some]
        second = _slope(model["member"][own] @ near.T + model["member_bias"][own, None], model["member_noise"][own], member[some])
        out["member"][own], out["member_bias"][own] = second @ near, second.sum(1)
        dq[:, some] += model["member"][own].T @ second
    out["weight"], out["context"] = _spread(model, context, dq, symbol, place, shape.end)
    return {k: v / len(symbol) for k, v in out.items()}


def learn(model: dict, shape: Shape, batches, rate: float) -> tuple[dict, int]:
    """(model after a step for each of ``batches`` of (symbols, places), tokens seen)."""
    model = {k: v.copy() for k, v in model.items()}
    one, two = ({k: np.zeros_like(model[k]) for k in LEARNED} for _ in range(2))
    tokens = 0
    for step, (symbol, place) in enumerate(batches, 1):
        tokens += len(symbol)
        for k, g in slopes(model, shape, symbol, place).items():
            one[k] += 0.1 * (g - one[k])
            two[k] += 0.01 * (g * g - two[k])
            fast = one[k] / (1 - 0.9**step)
            model[k] -= (rate * fast / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model, tokens


def _steps(batches):
    """(symbols, places) of about ``STEP`` tokens: whole texts, long ones in parts."""
    symbols, places, size = [], [], 0
    for batch in batches:
        for raw in batch.column(0):
            s = np.frombuffer(raw.as_buffer(), np.uint16).astype(np.int64)
            for lo in range(0, len(s), STEP):
                part = s[lo : lo + STEP]
                symbols.append(part)
                # A later part starts anew: its first tokens see ends before them.
                places.append(np.arange(len(part)))
                size += len(part)
                if size >= STEP:
                    yield np.concatenate(symbols), np.concatenate(places)
                    symbols, places, size = [], [], 0
    if size:
        yield np.concatenate(symbols), np.concatenate(places)


def train(streams: DataFrame, shape: Shape, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The model after all rounds over ``streams`` (symbols, slice)."""
    model = first_model(shape, counts)
    if not counts.sum():
        return model
    # A small corpus is passed over several times, by each task over its share.
    passes = max(1, -(-LEAST // int(counts.sum())))
    context, tasks = streams.sparkSession.sparkContext, streams.rdd.getNumPartitions()
    rounds = list(zip(np.cumsum((0, *SLICES)).tolist(), np.cumsum(SLICES).tolist()))
    sizes = [model[k].size for k in LEARNED]

    def flat(m):
        return np.concatenate([m[k].ravel() for k in LEARNED])

    def added(rows):
        total, tokens = np.zeros(sum(sizes)), 0
        for raw, n in rows:
            total += np.frombuffer(raw, np.float64) if len(raw) == 8 * len(total) else n * np.frombuffer(raw, np.float32)
            tokens += n
        return total, tokens

    def batch_of(raw, n):
        return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([n], pa.int64())], ["model", "n"])

    def gather(batches):
        total, tokens = added((r, n) for b in batches for r, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if tokens:
            yield batch_of(total.tobytes(), tokens)

    for i, (lo, hi) in enumerate(rounds):
        rate = RATE * (1 - i / len(rounds))
        shared = context.broadcast(model)

        def run(batches, rate=rate, shared=shared):
            steps = _steps(batches)
            if passes > 1:  # fewer than LEAST tokens in all
                steps = list(steps) * passes
            after, tokens = learn(shared.value, shape, steps, rate)
            if tokens:
                yield batch_of(flat(after).astype(np.float32).tobytes(), tokens)

        slice_ = streams.where((F.col("slice") >= lo) & (F.col("slice") < hi)).select("symbols")
        parts = slice_.mapInArrow(run, "model binary, n long")
        # Sums of some tasks each meet on the driver: the root of the number of tasks.
        rows = parts.repartition(max(1, math.isqrt(tasks))).mapInArrow(gather, "model binary, n long").collect()
        total, tokens = added((bytes(r.model), r.n) for r in rows)
        if tokens:
            cut = np.split((total / tokens).astype(np.float32), np.cumsum(sizes)[:-1])
            model = model | {k: v.reshape(model[k].shape) for k, v in zip(LEARNED, cut)}
    return model


def _log_of(score: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logs of the softmax of each column at its target."""
    score -= score.max(0)
    own = score[target, np.arange(len(target))].astype(np.float64)
    np.exp(score, out=score)
    return own - np.log((np.ones(len(score), score.dtype) @ score).astype(np.float64))


def log_chances(model: dict, shape: Shape, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 P(symbol | symbols before) of each token of some texts."""
    q = predictions(model, contexts(model, symbol, place, shape.end))
    group, member = shape.place(symbol)
    out = _log_of(model["group"] @ q.T + model["group_bias"][:, None], group)
    for g, some in _by_group(group, shape.groups):
        own = slice(g, None, shape.groups)
        out[some] += _log_of(model["member"][own] @ q[some].T + model["member_bias"][own, None], member[some])
    return out / np.log(10)


def _texts_log(model: dict, shape: Shape, share: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Of each text the sum of its symbols' log10 chances, without the totals of classes.

    A text beyond ``TOGETHER`` tokens is worked on in parts that see the tokens before.
    """
    if len(texts) == 1 and len(texts[0]) > TOGETHER:
        s, total = texts[0], 0.0
        for lo in range(0, len(s), TOGETHER):
            start = max(0, lo - FAR - 2)
            part = s[start : lo + TOGETHER]
            logs = log_chances(model, shape, part, np.arange(start, start + len(part)))
            total += (logs - share[part])[lo - start :].sum()
        return np.array([total])
    size = np.array([len(s) for s in texts])
    s = np.concatenate(texts)
    row = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
    return np.bincount(row, weights=log_chances(model, shape, s, place) - share[s], minlength=len(texts))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of bytes other than white space, A-Z lower-cased, and one end.
    Learns from the rows whose crc32(id as text) mod ``folds`` is not ``held``.
    base_score: smoothed unigrams; score: log10 of the model's probability of the text.

    Null and empty texts are an end alone; a null id hashes like the empty text; repeated
    rows are each scored and count each; without training rows all scores follow the
    same formulas with zero counts; an empty table gives no rows. Other columns are
    ignored, whatever their names. Words are told apart by 64-bit hashes.
    """
    fold = F.crc32(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    chosen = docs.select(
        column(id_col).cast("long").alias("id"), (fold == held).alias("held_out"),
        column(text_col).cast("binary").alias("text"),
    )
    counts = stored(word_counts(chosen.where("NOT held_out").select("text")), "counts")
    ends = chosen.where("NOT held_out").count()
    known_words = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    head, head_class, head_c, floor = head_of(counts, HEAD)
    shape = Shape(min(MOST, len(head_c), math.isqrt(known_words[0])))
    end = shape.end
    top = np.argsort(-head_c, kind="stable")[:end]
    symbols = end + 1 + head_class
    symbols[top] = np.arange(len(top))
    read = stored(
        read_texts(chosen, head, symbols, np.log10(head_c + 0.5), end)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("slice", F.pmod(F.xxhash64("symbols", "id"), F.lit(sum(SLICES))).cast("int")),
        "streams",
    )
    # Words and counts of each class: all of them without those that are symbols.
    of_class = np.zeros((CLASSES, 2))
    for r in counts.groupBy("class").agg(F.count("*").alias("v"), F.sum("c").alias("c")).collect():
        of_class[r["class"]] = r["v"], r["c"]
    np.subtract.at(of_class, head_class[top], np.stack([np.ones(len(top)), head_c[top]], 1))
    seen = np.concatenate([head_c[top], [ends], of_class[:, 1]]).astype(np.float64)
    learned = train(read.where("NOT held_out").select("symbols", "slice"), shape, seen)
    share = np.zeros(shape.symbols)
    share[end + 1 :] = np.log10(of_class[:, 1] + 0.5 * (of_class[:, 0] + 1))
    model = read.sparkSession.sparkContext.broadcast((learned, share))

    def predict(batches):
        for batch in batches:
            learned, share = model.value
            out = np.zeros(batch.num_rows)
            texts = [np.frombuffer(raw.as_buffer(), np.uint16).astype(np.int64) for raw in batch.column(1)]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= TOGETHER):
                    size, hi = size + len(texts[hi]), hi + 1
                out[lo:hi] = _texts_log(learned, shape, share, texts[lo:hi])
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["row", "symbol_log"])

    predicted = read.select("row", "symbols").mapInArrow(predict, "row long, symbol_log double")
    rare = read.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("word"), F.col("x.times").alias("times")
    )
    tail = counts.select("word", "c")
    if floor is not None:
        tail = tail.where(F.floor(F.log2("c") * 8) < floor)
    joined = rare.join(tail, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_n"),
    )
    tokens, kinds = known_words[1] + ends, known_words[0] + (1 if ends else 0)
    end_log, whole = float(np.log10(ends + 0.5)), float(np.log10(tokens + 0.5 * (kinds + 1)))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return (
        read.select("row", "id", "held_out", "n_tokens", "head_n", "all_log", "class_log")
        .join(predicted, "row").join(joined, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "held_out",
            "n_tokens",
            (F.col("head_n") + F.coalesce("rare_n", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("all_log") + rare_log + end_log - F.col("n_tokens") * whole).alias("base_score"),
            (F.col("symbol_log") + F.col("class_log") + rare_log).alias("score"),
        )
    )
