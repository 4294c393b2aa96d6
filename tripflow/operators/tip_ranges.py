"""Tip range distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tripflow.config import Service
from tripflow.functions.fares import tip_category, tip_label, tip_pct_order, tip_pct_range


def with_tip_pct_range(df: DataFrame, service: Service, bounded: bool) -> DataFrame:
    """Tip percent of the fare with its range; ``bounded`` keeps 0-25 % only."""
    fare = F.col(service.fare)
    pct = F.col("tip_percentage")
    ranged = df.where(fare > 0).withColumn("tip_percentage", F.col(service.tip) / fare * 100)
    if bounded:
        ranged = ranged.where(pct.between(0, 25))
    return ranged.withColumns(
        {
            "percentage_range": tip_pct_range(pct, service.name),
            "range_order": tip_pct_order(pct, service.name),
        }
    )


def tip_distribution(df: DataFrame, service: Service) -> DataFrame:
    """Trips per tip-percent range and percent of all, city-wide."""
    ranged = with_tip_pct_range(df, service, bounded=service.name == "yellow")
    return (
        ranged.groupBy("percentage_range", "range_order")
        .agg(F.count(F.lit(1)).alias("trips"))
        .withColumn("pct", F.col("trips") / F.sum("trips").over(Window.partitionBy()) * 100)
    )


def tip_distribution_by_borough(df: DataFrame, service: Service) -> DataFrame:
    """Trips per borough and range with the percent of the borough."""
    ranged = with_tip_pct_range(df, service, bounded=False)
    borough = Window.partitionBy("pickup_borough")
    return (
        ranged.groupBy("pickup_borough", "percentage_range", "range_order")
        .agg(F.count(F.lit(1)).alias("trips"))
        .withColumn("total_trips", F.sum("trips").over(borough))
        .withColumn("percentage_of_borough", F.col("trips") / F.col("total_trips") * 100)
    )


def tip_distribution_usd(df: DataFrame, service: Service) -> DataFrame:
    """Trips per dollar range."""
    category = tip_category(F.col(service.tip))
    return (
        df.where(F.col(service.fare) > 0)
        .groupBy(category.alias("_category"))
        .agg(F.count(F.lit(1)).alias("trips"))
        .select(
            tip_label(F.col("_category")).alias("tip_range"),
            (F.col("_category") + 1).alias("range_order"),
            "trips",
        )
    )
