"""The lookups behind the overview page, the zone pages and the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripflow.config import TIME_BANDS, TIP_LABELS, TIP_VALUES
from tripflow.functions.numeric import round_half_up
from tripflow.sources.reference_data import zone_dimension


def _suffix(service: str | None) -> str:
    return f"_{service}" if service else ""


def _name_has(column: str, part: str) -> Column:
    return F.coalesce(F.lower(column).contains(part.lower()), F.lit(False))


def top_demand_zones(demand: DataFrame, band: str = "any", service: str | None = None, n: int = 5) -> DataFrame:
    """Zones with most pickups in a time band, of a service or in all."""
    trips = f"trips{_suffix(service)}" if service else "avg_daily_pickups"
    pickups = f"pickups_{band}" if band in TIME_BANDS else trips
    return (
        demand.orderBy(F.desc(pickups), "PULocationID")
        .limit(n)
        .select(
            "pickup_zone",
            "pickup_borough",
            F.col(pickups).cast("double").alias("pickups"),
            F.col(trips).cast("double").alias("total_trips"),
            F.col(f"avg_tip_pct{_suffix(service)}").alias("avg_tip_pct"),
        )
    )


def top_tip_zones(demand: DataFrame, service: str | None = None, n: int = 5) -> DataFrame:
    """Zones with the highest mean tip percentage."""
    s = _suffix(service)
    trips = f"trips{s}" if service else "avg_daily_pickups"
    return (
        demand.orderBy(F.desc_nulls_last(f"avg_tip_pct{s}"), "PULocationID")
        .limit(n)
        .select(
            "pickup_zone",
            "pickup_borough",
            F.col(f"avg_tip_pct{s}").alias("avg_tip_pct"),
            F.col(f"avg_tip{s}").alias("avg_tip"),
            F.col(trips).cast("double").alias("total_trips"),
        )
    )


def zone_details(demand: DataFrame, name: str, service: str | None = None) -> DataFrame:
    """All zones whose name holds the text, with the columns of a service or all."""
    found = demand.where(_name_has("pickup_zone", name))
    if not service:
        return found
    per_service = ("trips", "avg_fare", "avg_tip", "avg_tip_pct", "avg_trip_miles", "avg_trip_time_secs")
    return found.select(
        "pickup_zone", "pickup_borough", "avg_daily_pickups", "yellow_share_pct", *[f"{c}_{service}" for c in per_service]
    )


def top_forecast_zones(forecast: DataFrame, hours_from_now: int = 1, n: int = 5) -> DataFrame:
    """Zones with most predicted pickups; 1 is the next hour, index 0 of the forecast."""
    return (
        forecast.where(F.col("hour") == hours_from_now - 1)
        .orderBy(F.desc("predicted_pickups"), "zone_id")
        .limit(n)
    )


def zone_forecast(forecast: DataFrame, name: str, max_hours: int | None = None) -> DataFrame:
    """Hourly forecast of the zones whose name holds the text."""
    found = forecast.where(_name_has("zone_name", name))
    if max_hours is not None:
        found = found.where(F.col("hour") < max_hours)
    return found.withColumn("next_hour", F.col("hour") + 1)


# ---- tips -------------------------------------------------------------------

PROBABILITIES = [f"prob_class_{i}" for i in range(len(TIP_VALUES))]


def expected_tip_by_zone(scores: DataFrame, zones: DataFrame) -> DataFrame:
    """Expected tip and likeliest category per zone, from the mean class probabilities.

    Zones without scored trips expect no tip.
    """
    means = scores.groupBy("zone_id").agg(*[F.avg(c).alias(c) for c in PROBABILITIES])
    dim = zone_dimension(means, "zone_id", *PROBABILITIES)
    parts = [F.coalesce(F.col(c), F.lit(0.0)) * v for c, v in zip(PROBABILITIES, TIP_VALUES)]
    highest = F.greatest(*PROBABILITIES)
    category = F.coalesce(
        *[F.when(F.col(c) == highest, F.lit(label)) for c, label in zip(PROBABILITIES, TIP_LABELS)],
        F.lit(TIP_LABELS[0]),
    )
    return zones.select(
        F.col("LocationID").alias("zone_id"), F.col("Zone").alias("zone_name"), F.col("Borough").alias("borough")
    ).join(dim, "zone_id", "left").withColumns(
        {"top_category": category, "expected_tip_usd": sum(parts[1:], parts[0])}
    )


def tip_by_zone_name(expected: DataFrame, name: str) -> DataFrame:
    return expected.where(_name_has("zone_name", name))


def sort_by_expected_tip(expected: DataFrame) -> DataFrame:
    return expected.orderBy(F.desc("expected_tip_usd"), "zone_id")


# ---- overview ---------------------------------------------------------------

def _share(service: str) -> Column:
    yellow = F.col("yellow_share_pct") / 100
    return yellow if service == "yellow" else 1 - yellow


def insights_overview(demand: DataFrame, service: str) -> DataFrame:
    """Total trips, unweighted means of the zone means, band totals by share of the service.

    Trip-weighted means stand beside the unweighted ones.
    """
    s = _suffix(service)
    share = _share(service)
    trips = F.col(f"trips{s}")

    def weighted(name: str, digits: int) -> Column:
        value = F.col(f"{name}{s}")
        known = F.sum(F.when(value.isNotNull(), trips))
        return round_half_up(F.sum(value * trips) / F.when(known != 0, known), digits)

    return demand.agg(
        F.sum(trips).alias("total_trips"),
        round_half_up(F.avg(f"avg_fare{s}"), 2).alias("avg_fare"),
        round_half_up(F.avg(f"avg_tip_pct{s}"), 1).alias("avg_tip_pct"),
        round_half_up(F.avg(f"avg_trip_miles{s}"), 1).alias("avg_trip_miles"),
        round_half_up(F.avg(f"avg_trip_time_secs{s}") / 60, 1).alias("avg_trip_time_min"),
        weighted("avg_fare", 2).alias("weighted_avg_fare"),
        weighted("avg_tip_pct", 1).alias("weighted_avg_tip_pct"),
        *[
            round_half_up(F.sum(F.col(f"pickups_{band}") * share), 0).cast("bigint").alias(f"pickups_{band}")
            for band in TIME_BANDS
        ],
    )


def overview_top_zones(demand: DataFrame, service: str, n: int = 15) -> DataFrame:
    """The busiest zones of a service with its daily pickups and means."""
    s = _suffix(service)
    means = ("avg_fare", "avg_tip", "avg_tip_pct", "avg_trip_miles", "avg_trip_time_secs")
    return (
        demand.orderBy(F.desc(f"trips{s}"), "PULocationID")
        .limit(n)
        .select(
            "PULocationID",
            "pickup_zone",
            "pickup_borough",
            (F.col("avg_daily_pickups") * _share(service)).alias("avg_daily_pickups"),
            *[F.col(f"{c}{s}").alias(c) for c in means],
            *[f"pickups_{band}" for band in TIME_BANDS],
        )
    )
