"""Token counts from an exact length histogram.

Documents are encoded once and counted by encoded length. Running sums over the
histogram answer every question about context limits without another pass: documents
and tokens above a limit, totals if every document is cut at a limit, and quantiles.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridwash.functions.cells import column
from gridwash.llm import words
from gridwash.llm.tables import stored

#: Lengths per block of the running sums.
SPAN = 4096
#: A text is encoded in parts of about this many bytes, cut where the pattern cuts anyway.
PART = 1 << 16


def encoded_lengths(docs: DataFrame, vocabulary: bytes, pattern: str, text_col: str = "text", keep=()) -> DataFrame:
    """(n_tokens, kept columns) per document; null and empty texts have 0 tokens.

    vocabulary: a rank file of a byte-level BPE (base64 token and rank per line), read
    once on the driver; pattern: its pre-splitting pattern. Special tokens in a text are
    ordinary text.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern))

    def count(batches):
        import tiktoken

        raw, pattern = shared.value
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = words.binary(batch.column(0))
            n = [sum(len(encoding.encode_ordinary(p)) for p in parts(t.as_py().decode("utf-8", "replace"))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), *batch.columns[1:]], ["n_tokens", *batch.schema.names[1:]])

    chosen = docs.select(column(text_col).cast("binary"), *[column(c).alias(c) for c in keep])
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in chosen.schema[1:])
    return chosen.mapInArrow(count, f"n_tokens long{kept}")


def parts(text: str, size: int = PART):
    """Pieces of a long text, cut before a space between two letters.

    There the pattern always starts a new word, so the pieces encode as the text does;
    a text without such a place stays whole.
    """
    lo = 0
    while len(text) - lo > 2 * size:
        at = text.find(" ", lo + size)
        while 0 < at < len(text) - 1 and not (text[at - 1].isalpha() and text[at + 1].isalpha()):
            at = text.find(" ", at + 1)
        if at <= lo or at >= len(text) - 1:
            break
        yield text[lo:at]
        lo = at
    yield text[lo:]


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs): how many documents have each length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with what lies up to and above each length, taken as a limit.

    docs_to, tokens_to: documents of at most n_tokens and their tokens; docs_above,
    tokens_above: longer ones; truncated_tokens: all tokens if each document is cut at
    n_tokens; share_to: docs_to of all documents (the quantile of the length).
    Sums run within blocks of ``SPAN`` lengths, and over the blocks' totals.
    """
    block = F.floor(F.col("n_tokens") / SPAN)
    rows = histogram.withColumn("_block", block).withColumn("_tokens", F.col("n_tokens") * F.col("docs"))
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = rows.groupBy("_block").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    above = totals.select(
        "_block",
        F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_da"), F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_ta"),
        F.sum("_d").over(every).alias("total_docs"), F.sum("_t").over(every).alias("total_tokens"),
    )
    longer = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(above, "_block").select(
        "n_tokens", "docs", "total_docs", "total_tokens",
        (F.col("_da") + F.coalesce(F.sum("docs").over(longer), F.lit(0))).alias("docs_above"),
        (F.col("_ta") + F.coalesce(F.sum("_tokens").over(longer), F.lit(0))).alias("tokens_above"),
    )
    return joined.select(
        "n_tokens", "docs",
        (F.col("total_docs") - F.col("docs_above")).alias("docs_to"),
        (F.col("total_tokens") - F.col("tokens_above")).alias("tokens_to"),
        "docs_above", "tokens_above",
        (F.col("total_tokens") - F.col("tokens_above") + F.col("n_tokens") * F.col("docs_above")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_above")) / F.col("total_docs")).alias("share_to"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> dict[int, dict]:
    """For each limit: docs_to, docs_above, truncated_tokens. An empty table gives zeros."""
    found = {}
    total = sums.agg(F.max(F.col("docs_to") + F.col("docs_above"))).first()[0] or 0
    wanted = [
        F.max_by(F.struct("n_tokens", "docs_to", "docs_above", "truncated_tokens"), F.when(F.col("n_tokens") <= x, F.col("n_tokens")))
        for x in limits
    ]
    for limit, r in zip(limits, sums.agg(*[w.alias(str(i)) for i, w in enumerate(wanted)]).first() if limits else []):
        # Above the last length that is reached, every longer document holds the limit.
        found[limit] = (
            {"docs_to": r["docs_to"], "docs_above": r["docs_above"],
             "truncated_tokens": r["truncated_tokens"] + (limit - r["n_tokens"]) * r["docs_above"]}
            if r is not None
            else {"docs_to": 0, "docs_above": total, "truncated_tokens": max(limit, 0) * total}
        )
    return found


def quantiles(sums: DataFrame, shares: list[float]) -> list[int | None]:
    """The smallest length that at least each share of the documents does not exceed."""
    wanted = [F.min(F.when(F.col("share_to") >= x, F.col("n_tokens"))).alias(str(i)) for i, x in enumerate(shares)]
    return list(sums.agg(*wanted).first()) if shares else []


def token_histogram(docs: DataFrame, vocabulary: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """Histogram of encoded lengths with its running sums; one row per length that occurs.

    Null and empty texts count as length 0, repeated rows count each, an empty table
    gives no rows, other columns are ignored.
    """
    return suffix_sums(stored(length_histogram(encoded_lengths(docs, vocabulary, pattern, text_col)), "lengths"))
