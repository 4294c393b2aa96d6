"""The graph of zones that share a border, and values carried along it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripflow.operators.spatial import undirected, zone_edges


def zone_adjacency(zones: DataFrame, id_col: str = "id", geometry: str = "geometry") -> DataFrame:
    """Both directions of every pair of zones with a common outline edge, and its length.

    Columns: zone_id, neighbour_id, border. Neighbours must use the same corner points. Edges of
    one zone that lie on each other (a cut, two of its parts) make no pair.
    """
    edges = undirected(zone_edges(zones.select(id_col, geometry), geometry).select(F.col(id_col).alias("zone_id"), "x1", "y1", "x2", "y2"))
    ends = ["x1", "y1", "x2", "y2"]
    once = edges.groupBy("zone_id", *ends).agg(F.count(F.lit(1)).alias("_n"))
    other = once.select(F.col("zone_id").alias("neighbour_id"), *ends)
    return (
        once.join(other, ends)
        .where(F.col("zone_id") != F.col("neighbour_id"))
        .groupBy("zone_id", "neighbour_id")
        .agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("border"))
    )


def neighbour_weights(adjacency: DataFrame, by_border: bool = False) -> DataFrame:
    """Weights of a zone's neighbours with sum 1: all alike, or by the length of the common border."""
    share = F.col("border") if by_border else F.lit(1.0)
    sums = adjacency.groupBy("zone_id").agg(F.sum(share).alias("_all"))
    return adjacency.join(sums, "zone_id").select("zone_id", "neighbour_id", (share / F.col("_all")).alias("weight"))


def neighbour_mean(rows: DataFrame, weights: DataFrame, value: str, name: str, at: list[str]) -> DataFrame:
    """``rows`` (one per zone and ``at``) with the weighted mean of ``value`` over the neighbours.

    A zone without neighbours, or whose neighbours have no row, gets 0. Every row sends itself to its zone and its
    weighted value to the zones it borders on; one aggregate puts both together. ``rows`` is read once, so chains
    of steps do not multiply the plan.
    """
    keys = ["zone_id", *at]
    others = [c for c in rows.columns if c not in keys]
    reach = weights.groupBy(F.col("neighbour_id").alias("zone_id")).agg(
        F.collect_list(F.struct(F.col("zone_id").alias("to"), "weight")).alias("_reach")
    )
    itself = F.array(F.struct(F.col("zone_id").alias("to"), F.lit(None).cast("double").alias("weight")))
    sent = rows.join(reach, "zone_id", "left").withColumn("_sent", F.explode(F.concat(itself, F.coalesce("_reach", F.array()))))
    own = F.when(F.col("_sent.weight").isNull(), F.struct(*others))
    share = F.col(value).cast("double") * F.col("_sent.weight")
    met = sent.groupBy(F.col("_sent.to").alias("zone_id"), *at).agg(
        F.any_value(own, F.lit(True)).alias("_own"), F.coalesce(F.sum(share), F.lit(0.0)).alias(name)
    )
    return met.where(F.col("_own").isNotNull()).select(*keys, "_own.*", name)


def graph_features(panel: DataFrame, weights: DataFrame, value: str = "pickups", hops: int = 2) -> DataFrame:
    """Panel with ``{value}_hop_k``: the value averaged over the neighbours ``k`` times."""
    out, last = panel, value
    for hop in range(1, hops + 1):
        name = f"{value}_hop_{hop}"
        out = neighbour_mean(out, weights, last, name, ["hour"])
        last = name
    return out
