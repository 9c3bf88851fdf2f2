"""Connected components of an edge table, by alternating star contractions.

Each round joins every node's neighbours to the least node of its neighbourhood: first those above the node
(large star), then those not above it (small star). The edge table never outgrows its start; after a number of rounds
that is logarithmic in practice it is a set of stars whose centres are the components' least nodes. Rounds are written
to the shared folder, so lineage stays short, and only three numbers per round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage_at, unstage


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return large.distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """edges: v < u for every row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    joined = edges.join(least, F.col("u") == F.col("c"))
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("c", "m").toDF("u", "v")).distinct()


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """node, component (its least node) for every node with an edge to another; nulls and loops are left out."""
    spark = edges.sparkSession
    a, b = F.col(left), F.col(right)
    edges = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, path = stage_at(edges.distinct())
    seen = None
    while True:
        after, after_path = stage_at(_small_stars(_stars(now)))
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(spark, path)
        now, path = after, after_path
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.toDF("node", "component").union(centres)
