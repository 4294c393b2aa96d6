"""Fare, tip and company columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripflow.config import (
    COMPANIES, RAIN_BOUNDS, RAIN_LABELS, Service, TIP_BOUNDS, TIP_LABELS, TIP_PCT_RANGES,
)
from tripflow.functions.calendar import seconds_between
from tripflow.functions.numeric import labelled, round_half_up


def tip_category(tip: Column) -> Column:
    """0 for no tip, then 1-4 by dollars. Category 1 covers everything in (0, 2)."""
    return F.when(tip == 0, F.lit(0)).otherwise(labelled(tip, TIP_BOUNDS, (1, 2, 3, 4)))


def tip_label(category: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in TIP_LABELS]), category.cast("int") + 1)


def tip_pct(tip: Column, total: Column) -> Column:
    """Tip as percent of the total, 0 where there is no positive total."""
    return F.when(total > 0, tip / total * 100).otherwise(F.lit(0.0))


def tip_pct_range(pct: Column, service: str) -> Column:
    bounds, labels = TIP_PCT_RANGES[service]
    return labelled(pct, bounds, labels)


def tip_pct_order(pct: Column, service: str) -> Column:
    """Position of the range, for sorting."""
    bounds, labels = TIP_PCT_RANGES[service]
    return labelled(pct, bounds, tuple(range(1, len(labels) + 1)))


def trip_length_class(distance: Column, cuts: tuple[float, float]) -> Column:
    return labelled(distance, cuts, ("short", "medium", "long"))


def rain_class(rain: Column) -> Column:
    """Right-closed classes; a negative reading of -1 or less has no class."""
    return F.when(rain > -1, labelled(rain, RAIN_BOUNDS, RAIN_LABELS, inclusive=True))


def company(license_number: Column) -> Column:
    """Company of a license number; an unknown number stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in COMPANIES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, license_number), license_number)


def yes_flag(flag: Column) -> Column:
    """Y/N text in any case -> boolean, anything else (null too) is false."""
    return F.coalesce(F.upper(flag) == "Y", F.lit(False))


FARE_PARTS = (
    "base_passenger_fare", "tolls", "sales_tax", "congestion_surcharge",
    "airport_fee", "tips", "cbd_congestion_fee",
)


def add_fare_components(df: DataFrame) -> DataFrame:
    """Total paid, waiting time and what the company keeps.

    Only trips on which the total exceeds the driver's pay stay.
    """
    total = sum((F.col(c) for c in FARE_PARTS[1:]), F.col(FARE_PARTS[0]))
    return (
        df.withColumn("total_amount", round_half_up(total, 2))
        .where(F.col("total_amount") > F.col("driver_pay"))
        .withColumns(
            {
                "wait_time": seconds_between("request_datetime", "pickup_datetime"),
                "company_fees": F.col("total_amount") - F.col("driver_pay"),
            }
        )
    )


def add_trip_columns(df: DataFrame, service: Service) -> DataFrame:
    """Per-service derived columns on cleaned trips."""
    if service.name == "fhvhv":
        df = df.withColumn("company", company(F.col("hvfhs_license_num"))).transform(
            add_fare_components
        )
    else:
        df = df.withColumn(
            service.duration, seconds_between("pickup_datetime", "dropoff_datetime")
        )
    return df.withColumn("tip_category", tip_category(F.col(service.tip)))
