"""Connected components of a table of links, in rounds of joins; no group of links meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.checkpoints import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root`: each node that has a link, with the smallest node that its links reach.

    Alternating large-star and small-star rounds; about log2 of the longest path many. Each round is two
    minima, pre-aggregated before the shuffle, and two joins, in which hot nodes can be split. Links with a null
    end and links of a node to itself join nothing; repeated links count once.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    state = None
    while (now := _digest(edges)) != state:
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "v")
        large = edges.join(nearest, "v").select("u", F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionByName(lowest.withColumnRenamed("m", "v")).distinct())
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
