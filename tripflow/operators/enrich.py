"""Dimension joins of trips: zones, points of interest, weather, tip means."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripflow.functions.calendar import hour_floor
from tripflow.functions.fares import tip_category
from tripflow.operators.joins import join_dimension
from tripflow.sources.reference_data import zone_dimension
from tripflow.sources.sinks import land

SIDES = {"pickup": "PULocationID", "dropoff": "DOLocationID"}


def join_zones(df: DataFrame, zones: DataFrame, how: str = "left") -> DataFrame:
    """Borough, zone and service zone of both ends.

    The zone dimension has one row per id, so no trip is doubled.
    """
    dim = zone_dimension(zones, "LocationID", "Borough", "Zone", "service_zone")
    for side, key in SIDES.items():
        named = dim.select(
            F.col("LocationID").alias("_zone_id"),
            F.col("Borough").alias(f"{side}_borough"),
            F.col("Zone").alias(f"{side}_zone"),
            F.col("service_zone").alias(f"{side}_service_zone"),
        )
        df = df.join(named, F.col(key) == F.col("_zone_id"), how).drop("_zone_id")
    return df


def join_pois(df: DataFrame, pois: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """POI figures of both ends as ``pu_poi_*`` and ``do_poi_*``."""
    dim = zone_dimension(pois, id_col, *columns)
    for prefix, key in (("pu_poi_", "PULocationID"), ("do_poi_", "DOLocationID")):
        named = dim.select(
            F.col(id_col).alias("_zone_id"), *[F.col(c).alias(prefix + c) for c in columns]
        )
        df = df.join(named, F.col(key) == F.col("_zone_id"), "left").drop("_zone_id")
    return df


def weather_by_hour(weather: DataFrame, columns: list[str]) -> DataFrame:
    """One row per zone and hour; duplicate readings are averaged."""
    return (
        weather.withColumn("weather_hour", hour_floor("datetime"))
        .groupBy(F.col("id").alias("weather_zone"), "weather_hour")
        .agg(*[F.avg(c).alias(c) for c in columns])
    )


def join_weather(
    df: DataFrame,
    weather: DataFrame,
    columns: list[str],
    required: list[str] | None = None,
) -> DataFrame:
    """Weather of the pickup hour and zone; only rows complete in ``required`` stay.

    Trips meet readings on zone and hour; adaptive execution broadcasts a small table
    and splits a crowded zone-hour.
    """
    keyed = df.withColumns(
        {"weather_hour": hour_floor("pickup_datetime"), "weather_zone": F.col("PULocationID")}
    )
    joined = join_dimension(
        keyed,
        weather_by_hour(weather, columns),
        ["weather_zone", "weather_hour"],
        how="inner",
    )
    return joined.na.drop(subset=required or columns).drop("weather_hour", "weather_zone")


def hourly_counts(df: DataFrame, ts: str = "pickup_datetime", zone: str = "PULocationID") -> DataFrame:
    """Trips per zone and hour."""
    return df.groupBy(hour_floor(ts).alias("hour"), F.col(zone).alias("zone_id")).agg(
        F.count(F.lit(1)).alias("trips")
    )


def demand_weather(counts: DataFrame, weather: DataFrame) -> DataFrame:
    """Hourly counts with the rain of that hour and zone; hours without a reading drop out.

    Both sides hold one row per zone-hour, so a plain hash join is even.
    """
    rain = weather_by_hour(weather, ["rain"]).select(
        F.col("weather_zone").alias("zone_id"), F.col("weather_hour").alias("hour"), "rain"
    )
    return counts.join(rain, ["zone_id", "hour"]).where(F.col("rain").isNotNull())


def keep_boroughs(df: DataFrame, zones: DataFrame, pickup: str, dropoff: str) -> DataFrame:
    """Trips from one borough to another, by semi joins on the zone ids."""
    dim = zone_dimension(zones, "LocationID", "Borough")
    for key, borough in (("PULocationID", pickup), ("DOLocationID", dropoff)):
        ids = dim.where(F.col("Borough") == borough).select(F.col("LocationID").alias(key))
        df = df.join(ids, key, "left_semi")
    return df


def flag_high_ses(df: DataFrame, ses: DataFrame) -> DataFrame:
    """Whether the dropoff zone has a high-SES place (null for an unknown zone).

    The flags are written first: their file size, not that of what they come from, decides how trips meet them.
    """
    flags = zone_dimension(ses.withColumn("is_high_SES", F.col("high_SES_count") > 0), "id", "is_high_SES")
    dim = land(flags, "dimension")
    return df.join(
        dim.withColumnRenamed("id", "_zone_id"),
        F.col("DOLocationID") == F.col("_zone_id"),
        "left",
    ).drop("_zone_id")


def tip_baseline(train: DataFrame, test: DataFrame, tip: str = "tip_amount") -> DataFrame:
    """Test rows with the category of the mean training tip of their zone.

    A zone without training rows has no mean and falls into the last category. The means are written first, so
    that their size decides how the test rows meet them.
    """
    means = (
        train.where(F.col("PULocationID").isNotNull())
        .groupBy("PULocationID")
        .agg(F.avg(tip).alias("predicted_tip"))
    )
    dim = land(zone_dimension(means, "PULocationID", "predicted_tip"), "dimension")
    return test.join(dim, "PULocationID", "left").withColumn(
        "predicted_category", F.coalesce(tip_category(F.col("predicted_tip")), F.lit(4))
    )


def top1_accuracy(predictions: DataFrame) -> DataFrame:
    correct = (F.col("tip_category") == F.col("predicted_category")).cast("double")
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.avg(correct), F.lit(0.0)).alias("accuracy")
    )
