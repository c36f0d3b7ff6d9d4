"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwash.functions.cells import column
from gridwash.llm.tables import stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of bytes other than white space (null: 0)."""
    parts = F.split(text, SPACE)
    # Only the first and the last part can be empty.
    ends = F.when(parts[0] == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts) - ends).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, rank) from (source, source_size): water-filling.

    Sources by code point, null last, take the weights in turn and share ``budget``
    times all words; no target exceeds ``most`` times its source, and what that leaves
    is shared again by weight. A source is full if its level (cap / weight) is not
    above the common level that remains after all lower ones are full. One row per
    source, so the windows see the list of sources only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    listed = sizes.select("source", "source_size", F.row_number().over(order).alias("rank")).select(
        "*",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).alias("_w"),
        (F.lit(most) * F.col("source_size")).alias("_cap"),
        (F.lit(budget) * F.sum("source_size").over(every)).alias("_budget"),
    )
    below = Window.orderBy(F.col("_cap") / F.col("_w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_budget") - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))
    shares = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(below), F.lit(0))
    full = listed.withColumn("_full", left / shares >= F.col("_cap") / F.col("_w"))
    held = F.col("_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0.0))
    open_w = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(every)
    return full.select(
        "source",
        "source_size",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * (held / open_w)).alias("target"),
        "rank",
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    budget: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """Per document: id, source, size, source_size, target, taken (words, repeats counted).

    Every source is shuffled by a hash of the id and offered up to twice. A copy's
    virtual finish time is the running sum of its source's words divided by the
    source's target; all copies are range-sorted by it and taken in order while their
    words fit the total budget. Running sums go over (source, first hash digits)
    blocks, so a source with a third of all rows is spread over 4,096 blocks.

    Null text has size 0; empty documents take nothing; a null source is a source of
    its own, the last; null ids hash like the empty id; repeated rows are each placed;
    an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if most > 2:
        raise ValueError("a source is offered at most twice")
    shuffle = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit(""))))
    sized = stored(
        docs.select(
            column(id_col).alias("_id"),
            column(source_col).alias("source"),
            word_count(column(text_col)).alias("size"),
            shuffle.alias("_key"),
        ).withColumn("_block", F.substring("_key", 1, 3)),
        "sized",
    )
    blocks = stored(sized.groupBy("source", "_block").agg(F.sum("size").alias("_sum")), "blocks")
    goal = targets(blocks.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, budget, most)
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_block")) - F.col("_sum")
    starts = blocks.withColumn("_start", before).alias("b").join(
        goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))
    ).select(F.col("b._block"), "_start", "source_size", "target", "rank", F.col("b.source"))
    inside = Window.partitionBy("source", "_block").orderBy("_key", "_id", "size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = sized.withColumn("_sum", F.sum("size").over(inside)).alias("d").join(
        starts.alias("s"),
        F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._block") == F.col("s._block")),
    )
    placed = stored(
        placed.select(
            "_id", F.col("d.source"), "size", "source_size", "target", "rank",
            (F.col("_start") + F.col("_sum")).alias("_place"),
        ),
        "placed",
    )
    last = _first_left_out(placed, budget)
    again = F.col("_place") + F.col("source_size")
    copies = sum(_before(place, last).cast("long") for place in (F.col("_place"), again))
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("source").alias(source_col),
        "size", "source_size", "target",
        (F.col("size") * copies).alias("taken"),
    )


def _finish(place: Column) -> Column:
    return F.when(F.col("target") > 0, place / F.col("target")).otherwise(F.lit(0.0))


def _before(place: Column, last) -> Column:
    """Whether the copy at ``place`` sorts before the first copy left out."""
    if last is None:
        return F.lit(True)
    finish, rank, at = (F.lit(x) for x in last)
    now = _finish(place)
    return (now < finish) | (
        (now == finish) & ((F.col("rank") < rank) | ((F.col("rank") == rank) & (place < at)))
    )


def _first_left_out(placed: DataFrame, budget: float):
    """Sort key of the first copy that doesn't fit the total budget, None if all fit.

    The sums of the range partitions (one number each) tell in which partition the
    budget ends; only that one is summed row by row.
    """
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    copies = placed.where("size > 0").withColumn("_copy", both).withColumn(
        "_at", F.col("_place") + F.col("_copy") * F.col("source_size")
    )
    ranged = stored(
        copies.select(_finish(F.col("_at")).alias("_finish"), "rank", "_at", "size")
        .repartitionByRange("_finish", "rank", "_at")
        .withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    # Every copy is there twice, so all words are half of the copies' words.
    sums = sorted(tuple(r) for r in ranged.groupBy("_part").agg(F.sum("size")).collect())
    room = budget * sum(s for _, s in sums) / 2
    for part, words in sums:
        if words > room:
            run = F.sum("size").over(
                Window.orderBy("_finish", "rank", "_at").rowsBetween(Window.unboundedPreceding, 0)
            )
            over = ranged.where(F.col("_part") == part).withColumn("_run", run).where(F.col("_run") > room)
            first = over.agg(F.min(F.struct("_finish", "rank", "_at"))).first()[0]
            return tuple(first)
        room -= words
    return None


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk
      FROM d GROUP BY source),
l AS (SELECT *, CASE rnk % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS w, 2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM s),
f AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) >= cap / w AS is_full
      FROM l WINDOW b AS (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, rnk, budget,
             CASE WHEN is_full THEN cap
                  ELSE w * ((budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0))
                            / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) END AS target FROM f),
p AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.rnk, g.budget,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS place
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT p.*, place + e * source_size AS pos,
             CASE WHEN target > 0 THEN (place + e * source_size) / target ELSE 0 END AS fin
      FROM p CROSS JOIN (VALUES (0), (1)) t(e)),
r AS (SELECT *, sum(size) OVER (ORDER BY fin, rnk, pos, size ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT doc_id, source, size, source_size, target,
       CAST(sum(CASE WHEN run <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM r GROUP BY doc_id, source, size, source_size, target, place
"""
