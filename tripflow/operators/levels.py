"""Demand shares and levels, scaling and the purchasing-power index.

All of these work on tables with one row per zone (or zone and time of day), so an
unpartitioned window over them is bounded and spares a second pass over the trips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.config import LEVEL_CUTS, LEVEL_LABELS
from tripflow.functions.numeric import ratio, round_half_up
from tripflow.operators.quantiles import exact_percentiles
from tripflow.sources.reference_data import zone_dimension

def _whole():
    return Window.partitionBy()


def demand_share(trips: DataFrame) -> DataFrame:
    """Trips per time of day and zone with the percent of that time of day."""
    counts = trips.groupBy("time_of_day", "pickup_zone").agg(F.count(F.lit(1)).alias("trip_number"))
    total = F.sum("trip_number").over(Window.partitionBy("time_of_day"))
    return counts.withColumn("total_trips_per_time", total).withColumn(
        "avg_demand", round_half_up(F.col("trip_number") / F.col("total_trips_per_time") * 100, 4)
    )


def _level(value: str) -> Column:
    """Label by the percentile cuts of the column itself over the whole table.

    The accuracy exceeds the number of rows, which makes the sketch exact.
    """
    cuts = F.percentile_approx(value, list(LEVEL_CUTS), 1_000_000).over(_whole())
    chain = F.when(F.col(value) <= cuts[0], LEVEL_LABELS[0])
    for i, label in enumerate(LEVEL_LABELS[1:-1], start=1):
        chain = chain.when(F.col(value) <= cuts[i], label)
    return chain.otherwise(LEVEL_LABELS[-1])


def demand_levels(trips: DataFrame) -> DataFrame:
    """Demand shares with a level for the number of trips and one for the share."""
    return demand_share(trips).withColumns(
        {"level": _level("trip_number"), "avg_level": _level("avg_demand")}
    )


def minmax_scale(df: DataFrame, columns: list[str], suffix: str = "_norm") -> DataFrame:
    """Columns scaled to 0-1; a column with a single value becomes 0."""

    def scaled(name: str) -> Column:
        low, high = F.min(name).over(_whole()), F.max(name).over(_whole())
        return F.when(
            F.col(name).isNotNull(), F.coalesce(ratio(F.col(name) - low, high - low), F.lit(0.0))
        )

    return df.withColumns({name + suffix: scaled(name) for name in columns})


# ---- fixed values -----------------------------------------------------------
WEALTH_WEIGHTS = {
    "yellow": {"avg_tip_pct": 0.4, "avg_daily_pickups": 0.3, "median_fare": 0.3},
    "fhvhv": {"avg_tip_pct": 0.2, "avg_daily_pickups": 0.3, "median_fare": 0.5},
    "pois": {
        "avg_tip_pct": 0.2, "avg_daily_pickups": 0.2, "median_fare": 0.2,
        "trips_to_high_SES_pct": 0.2, "low_SES_density": 0.2,
    },
    "full": {
        "avg_tip_pct": 0.1, "avg_daily_pickups": 0.18, "median_fare": 0.18,
        "trips_to_high_SES_pct": 0.18, "low_SES_density": 0.18, "median_price_per_sqft": 0.18,
    },
}
MIN_DAILY_PICKUPS = 5.0
MIN_LOW_SES_DENSITY = -90
MIN_SALES = 5
# ---- end of fixed values ----------------------------------------------------


def wealth_index(df: DataFrame, kind: str, min_pickups: float = MIN_DAILY_PICKUPS) -> DataFrame:
    """Weighted sum of scaled zone figures; rare, airport and thinly traded zones are out."""
    weights = WEALTH_WEIGHTS[kind]
    kept = df.where(
        (F.col("avg_daily_pickups") > min_pickups) & ~F.col("pickup_zone").contains("Airport")
    )
    if kind == "pois":
        kept = kept.where(F.col("low_SES_density") > MIN_LOW_SES_DENSITY)
    if kind == "full":
        kept = kept.where(F.col("num_sells") > MIN_SALES)
    parts = [F.col(f"{c}_norm") * w for c, w in weights.items()]
    return minmax_scale(kept, list(weights)).withColumn("wealth_index", sum(parts[1:], parts[0]))


def house_prices(df: DataFrame, max_price: float = 10_000, borough: str | None = None) -> DataFrame:
    """Zones of the house price map."""
    kept = df.where((F.col("num_sells") > MIN_SALES) & (F.col("mean_price_per_sqft") < max_price))
    return kept.where(F.col("pickup_borough") == borough) if borough else kept


def sales_by_zone(sales: DataFrame, cap: float = 0.95) -> DataFrame:
    """Mean and median price per square foot and number of sales per zone.

    Prices above the ``cap`` percentile count as that percentile.
    """
    limit = exact_percentiles(sales, [], "price_per_sqft", {"p": cap}).scalar()
    capped = sales.withColumn("price_per_sqft", F.least(F.col("price_per_sqft"), limit))
    by_zone = capped.groupBy("taxi_zone_id").agg(
        F.avg("price_per_sqft").alias("mean_price_per_sqft"), F.count(F.lit(1)).alias("num_sells")
    )
    median = exact_percentiles(capped, ["taxi_zone_id"], "price_per_sqft", {"median_price_per_sqft": 0.5})
    return by_zone.join(median, "taxi_zone_id")


def wealth_inputs(demand: DataFrame, ses: DataFrame, sales: DataFrame) -> DataFrame:
    """Zone demand with the low-SES density and the house prices of the zone."""
    low = zone_dimension(ses, "id", "low_SES_density").withColumnRenamed("id", "PULocationID")
    prices = zone_dimension(
        sales, "taxi_zone_id", "mean_price_per_sqft", "median_price_per_sqft", "num_sells"
    ).withColumnRenamed("taxi_zone_id", "PULocationID")
    return demand.join(low, "PULocationID", "left").join(
        prices, "PULocationID", "left"
    )
