"""Intermediate tables in the folder all executors share, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwash.session import scratch_path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage; a lost executor only costs the tasks it was running.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the folder of a table that ``stored`` wrote and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``links`` (a, b).

    Alternates the large-star and small-star steps of the map-reduce algorithm until
    nothing changes; every round is one grouped minimum per step, so a hub with any
    number of links is only ever reduced by an aggregate that combines map-side.
    Links must be non-null; self links keep a node in the result.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links"
    )
    nodes = edges
    before = None
    while True:
        pairs = edges.where("u <> v")
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours point to the smallest neighbour.
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("v"), F.col("m").alias("u"))
            .union(least.select(F.col("u").alias("v"), F.col("m").alias("u")))
            .where("u <> v").distinct()
        )
        large = stored(large, "large")
        # Small star: smaller neighbours and the node itself point to the smallest.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
            .union(low.select("v", F.col("m").alias("u")))
            .where("u <> v").distinct()
        )
        after = stored(small, "small")
        drop_stored(large)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if edges is not nodes:
            drop_stored(edges)
        edges = after
        if mark == before:
            break
        before = mark
    every = nodes.select(F.col("u").alias("node")).union(nodes.select(F.col("v").alias("node"))).distinct()
    return every.join(edges.select(F.col("v").alias("node"), F.col("u").alias("_root")), "node", "left").select(
        "node", F.coalesce("_root", "node").alias("root")
    )
