"""Usage accounting over call logs: token cost, running totals, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwash.functions import cells, rules
from gridwash.operators.ordered import GROUP_LIMIT, as_of, running_total


def price_table(spark, prices=rules.PRICES) -> DataFrame:
    """provider, input_price, output_price per million tokens."""
    return spark.createDataFrame(
        list(prices), "provider string, input_price double, output_price double"
    )


def usage_cost(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """provider, calls, input_tokens, output_tokens, total_tokens, cost.

    Tokens are summed per provider first; prices join to that handful of rows.
    """
    prices = price_table(calls.sparkSession) if prices is None else prices
    totals = calls.groupBy("provider").agg(
        F.count("*").alias("calls"),
        F.sum(F.col("input_tokens").cast("long")).alias("input_tokens"),
        F.sum(F.col("output_tokens").cast("long")).alias("output_tokens"),
    )
    million = F.lit(1_000_000.0)
    return totals.join(prices, "provider", "left").select(
        "provider",
        "calls",
        "input_tokens",
        "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        (
            F.col("input_tokens") * F.col("input_price") / million
            + F.col("output_tokens") * F.col("output_price") / million
        ).alias("cost"),
    )


def usage_cost_by_date(
    calls: DataFrame, prices: DataFrame, ts: str = "ts", valid_from: str = "valid_from", group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """provider, input_price, output_price, calls, input_tokens, output_tokens,
    total_tokens, cost: usage at the prices that held at the time of each call.

    ``prices`` has provider, ``valid_from``, input_price and output_price per million
    tokens; a price holds from its instant on until the provider's next one. Calls before
    the first price, of an unknown provider or without a time have no price and no cost;
    they are counted in a row of their own, so no call is lost. A price that is known
    late counts from its ``valid_from``, whenever it was stored; of prices of one provider
    and instant the larger holds.
    """
    priced = as_of(
        calls.select("provider", cells.column(ts).alias("ts"), "input_tokens", "output_tokens"),
        prices, "provider", "ts", valid_from, ["input_price", "output_price"], group_limit,
    )
    totals = priced.groupBy("provider", "input_price", "output_price").agg(
        F.count("*").alias("calls"),
        F.sum(F.col("input_tokens").cast("long")).alias("input_tokens"),
        F.sum(F.col("output_tokens").cast("long")).alias("output_tokens"),
    )
    million = F.lit(1_000_000.0)
    return totals.select(
        "*",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        (
            F.col("input_tokens") * F.col("input_price") / million
            + F.col("output_tokens") * F.col("output_price") / million
        ).alias("cost"),
    )


def running_usage(calls: DataFrame, keys, order_by, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The calls plus tokens, running_tokens and delta from the previous call of the key."""
    tokens = (F.col("input_tokens") + F.col("output_tokens")).cast("long")
    return running_total(
        calls.withColumn("tokens", tokens),
        keys,
        order_by,
        "tokens",
        "running_tokens",
        "delta",
        group_limit,
    )


def rate_limit_breaches(log: DataFrame, limits: dict | None = None) -> DataFrame:
    """window_start, kind, n, limit for every tumbling window above its limit.

    ``log`` has ``ts`` and ``kind``; ``limits`` maps a kind to (count, window length).
    Works on a streaming log too when a watermark on ``ts`` is set.
    """
    limits = rules.LIMITS if limits is None else limits
    out = None
    for length in sorted({w for _, w in limits.values()}):
        kinds = {k: n for k, (n, w) in limits.items() if w == length}
        bound = F.create_map(*[x for k, n in kinds.items() for x in (F.lit(k), F.lit(n))])
        counted = (
            log.where(F.col("kind").isin(*kinds))
            .groupBy(F.window("ts", length).alias("w"), "kind")
            .agg(F.count("*").alias("n"))
            .withColumn("limit", bound[F.col("kind")].cast("long"))
            .where(F.col("n") > F.col("limit"))
            .select(F.col("w.start").alias("window_start"), "kind", "n", "limit")
        )
        out = counted if out is None else out.unionByName(counted)
    return out
