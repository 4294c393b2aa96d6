"""Services, limits and the fixed value lists the operators work with."""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---- fixed values -----------------------------------------------------------
# Zone ids
UNKNOWN_ZONES = (264, 265)
AIRPORT_ZONES = (1, 132, 138)
CBD_CORE_ZONES = (161, 162, 163, 164, 186, 229, 230, 231)

# License number -> company
COMPANIES = {
    "HV0002": "Juno",
    "HV0003": "Uber",
    "HV0004": "Via",
    "HV0005": "Lyft",
}

# Time bands of the zone summary: first and last hour
TIME_BANDS = {
    "morning": (6, 11),
    "afternoon": (12, 17),
    "evening": (18, 23),
    "night": (0, 5),
}

# Times of day of the calendar columns: first and last hour
TIMES_OF_DAY = {
    "late_night": (0, 5),
    "morning_rush": (6, 9),
    "midday": (10, 15),
    "evening_rush": (16, 19),
    "night": (20, 23),
}

DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# Tip categories: exclusive upper bound in dollars of categories 1, 2, 3
TIP_BOUNDS = (2, 3, 5)
TIP_LABELS = ("$0", "$1-2", "$2-3", "$3-5", "$5+")
TIP_VALUES = (0.0, 1.5, 2.5, 4.0, 6.0)

# Tip ranges in percent: exclusive upper bounds, the last range is open
TIP_PCT_RANGES = {
    "yellow": ((5, 10, 15, 20), ("0-5%", "5-10%", "10-15%", "15-20%", "20-25%")),
    "fhvhv": (
        (5, 10, 15, 20, 25, 30),
        ("0-5%", "5-10%", "10-15%", "15-20%", "20-25%", "25-30%", "30-50%"),
    ),
}

# Rain classes: inclusive upper bound in mm, the last class is open
RAIN_BOUNDS = (0.0, 2.5, 15.0)
RAIN_LABELS = ("no rain", "light rain", "moderate rain", "heavy rain")

# Demand levels: percentile cut below which (inclusive) a label applies
LEVEL_CUTS = (0.25, 0.50, 0.75, 0.85, 0.95, 0.99)
LEVEL_LABELS = (
    "Very Low", "Low", "Medium", "High", "Very High", "Extremely High", "Saturated",
)

TAIL_PERCENTILES = (0.95, 0.99, 0.999, 0.9999)
# ---- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """Bounds of the cleaning rules. Date bounds are half-open everywhere."""

    date_from: str
    date_to: str
    miles: tuple[float, float]
    fare: tuple[float, float]
    tip_cap: float
    seconds: tuple[int, int] | None = None
    zones: tuple[int, int] = (1, 263)
    airports: tuple[int, ...] = AIRPORT_ZONES
    cbd_zones: tuple[int, ...] = CBD_CORE_ZONES


@dataclass(frozen=True)
class Service:
    """Column names and rules of one kind of trip record."""

    name: str
    limits: Limits
    renames: dict[str, str]
    distance: str = "trip_distance"
    tip: str = "tip_amount"
    fare: str = "total_amount"          # base of the fare limits and the tip cap
    total: str = "total_amount"
    duration: str = "trip_time"
    length_cuts: tuple[float, float] = (1.5, 5.0)
    cost_caps: tuple[float | None, float | None, float | None] = (35.0, 65.0, None)
    cost_hour: str = "pickup_hour"
    cost_years: tuple[int, int] | None = (2023, 2025)

    def with_limits(self, **changes) -> "Service":
        return replace(self, limits=replace(self.limits, **changes))


YELLOW = Service(
    name="yellow",
    limits=Limits("2020-01-01", "2026-01-01", (0.1, 35.0), (1.0, 200.0), 0.25),
    renames={
        "tpep_pickup_datetime": "pickup_datetime",
        "tpep_dropoff_datetime": "dropoff_datetime",
    },
)

GREEN = Service(
    name="green",
    limits=Limits("2020-01-01", "2026-01-01", (0.1, 35.0), (1.0, 200.0), 0.25),
    renames={
        "lpep_pickup_datetime": "pickup_datetime",
        "lpep_dropoff_datetime": "dropoff_datetime",
    },
)

FHVHV = Service(
    name="fhvhv",
    limits=Limits(
        "2020-01-01", "2026-01-01", (0.1, 60.0), (1.0, 250.0), 0.5, seconds=(300, 7200)
    ),
    renames={},
    distance="trip_miles",
    tip="tips",
    fare="base_passenger_fare",
    length_cuts=(1.5, 6.0),
    cost_caps=(50.0, 100.0, None),
    cost_hour="request_hour",
    cost_years=None,
)
