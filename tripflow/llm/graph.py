"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import drop, few_files, land


def are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v``, and no ``v`` has one itself: then each ``v`` is the smallest node of its component."""
    link, top = F.lit(1).alias("links"), F.lit(1).alias("top")
    nodes = edges.select(F.col("u").alias("node"), link, F.lit(0).alias("top"))
    nodes = nodes.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("links"), top))
    counts = nodes.groupBy("node").agg(F.sum("links").alias("links"), F.max("top").alias("top"))
    return counts.where("links > 1 or links = 1 and top = 1").isEmpty()


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of ``links`` (a, b), which has not many more than ``rows`` rows.

    Needs a number of steps that grows with the logarithm of the longest path. A node
    with very many links is only ever reduced by partial aggregates and skew joins.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = land(few_files(edges, rows), "links")
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(least, "u")
            .where("v <> low")
            .select(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v"))
            .unionByName(least.withColumnRenamed("low", "v"))
            .distinct()
        )
        stars = land(few_files(small, rows), "stars")
        drop(edges)
        edges = stars
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
