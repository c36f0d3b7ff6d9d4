"""Operators on streams: row-local cleaning, and state over late and repeated events.

Cleaning, validity and repair are projections, so they run on a streaming
DataFrame unchanged; whole-table decisions (formats, names) are made beforehand on
a bounded table and passed in. What needs state keeps it per key, bounded by a
watermark: windows, sessions and seen ids are dropped once it has passed them, running
totals once a key has been silent for some time. State is in the query's checkpoint
folder, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridwash.functions import cells
from gridwash.operators import structure, usage, validation
from gridwash.operators.convert import map_text
from gridwash.operators.sampling import as_list
from gridwash.plans.apply import ROW_LOCAL


def clean_stream(
    stream: DataFrame, steps, order_by=(), formats: dict[str, str] | None = None
) -> DataFrame:
    """Drop empty rows, apply row-local steps, repair and mark known formats."""
    out = structure.drop_empty_rows(stream, order_by)
    for step in steps:
        out = map_text(out, ROW_LOCAL[step], order_by)
    if formats:
        out = validation.auto_standardize(out, order_by, formats)
        out = validation.mark_violations(out, order_by, formats)
    return out


def watch_limits(log: DataFrame, lateness: str = "10 minutes", limits: dict | None = None) -> DataFrame:
    """Rate-limit breaches of a streaming event log; later events than ``lateness`` drop."""
    return usage.rate_limit_breaches(log.withWatermark("ts", lateness), limits)


def drop_repeats(stream: DataFrame, keys, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """The stream without events whose keys came within ``lateness`` before (event time).

    The first to arrive is kept. An id is remembered until the watermark has passed its
    event by ``lateness``, so state holds the ids of that time only; on a table, where
    all rows are there, use ``duplicates.deduplicate``.
    """
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(as_list(keys))


def sessions(
    log: DataFrame, keys, gap: str = "30 minutes", ts: str = "ts", lateness: str = "10 minutes", values=()
) -> DataFrame:
    """keys, session_start, session_end, events, and the sum of each of ``values``: events
    of a key less than ``gap`` apart are one session.

    On a stream a session is given out once the watermark has passed its end, and later
    events than ``lateness`` are dropped; on a table all sessions are. A session ends
    ``gap`` after its last event. Events without a time are in no session.
    """
    dated = log.where(cells.column(ts).isNotNull())
    if log.isStreaming:
        dated = dated.withWatermark(ts, lateness)
    window = F.session_window(cells.column(ts), gap).alias("_w")
    totals = dated.groupBy(*[cells.column(k) for k in as_list(keys)], window).agg(
        F.count("*").alias("events"), *[F.sum(cells.column(v)).alias(v) for v in as_list(values)]
    )
    return totals.select(
        *[cells.column(k) for k in as_list(keys)], F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"),
        "events", *[cells.column(v) for v in as_list(values)],
    )


USAGE = "provider string, ts timestamp, kind string, calls long, tokens long, running_tokens long"


def running_usage(calls: DataFrame, lateness: str = "10 minutes", idle_minutes: int = 60) -> DataFrame:
    """provider, ts, kind, calls, tokens, running_tokens: usage of each provider so far.

    For every micro-batch and provider a row of kind 'usage': how many calls and tokens
    came, the time of the newest, and all tokens of the provider up to now. A provider
    whose watermark is ``idle_minutes`` past its newest call gets one row of kind 'idle'
    with its totals and is forgotten; its next call starts at zero. Events without a time,
    and those later than ``lateness``, do not count; null tokens are zero, a null
    provider is one. State is three numbers per provider.
    """
    idle = idle_minutes * 60_000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls_before, total, newest = state.get if state.exists else (0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            kind, came, tokens = "idle", calls_before, 0
        else:
            kind, came, tokens = "usage", 0, 0
            for pdf in batches:
                came += len(pdf)
                tokens += int(pdf["tokens"].sum())
                newest = max(newest, int(pdf["ms"].max()))
            total += tokens
            state.update((calls_before + came, total, newest))
            # A timer has to lie ahead of the watermark.
            state.setTimeoutTimestamp(max(newest + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            [(key[0], pd.Timestamp(newest, unit="ms"), kind, came, tokens, total)],
            columns=["provider", "ts", "kind", "calls", "tokens", "running_tokens"],
        )

    tokens = sum((F.coalesce(cells.column(c), F.lit(0)) for c in ("input_tokens", "output_tokens")), F.lit(0)).cast("long")
    known = calls.where("ts IS NOT NULL").select("provider", "ts", tokens.alias("tokens")).withWatermark("ts", lateness)
    return (
        known.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
        .groupBy("provider")
        .applyInPandasWithState(update, USAGE, "calls long, total long, newest long", "append", GroupStateTimeout.EventTimeTimeout)
    )
