"""Quality rules as named predicates, and the profiles built from the same names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripflow.config import Service
from tripflow.functions.calendar import seconds_between
from tripflow.functions.fares import yes_flag
from tripflow.functions.numeric import all_of, count_if, holds, ratio, round_half_up

Rule = tuple[str, Column]


# ---- rules ------------------------------------------------------------------

def _zones_known(service: Service) -> Column:
    low, high = service.limits.zones
    return F.col("PULocationID").between(low, high) & F.col("DOLocationID").between(low, high)


def touches_airport(service: Service) -> Column:
    ids = service.limits.airports
    return F.col("PULocationID").isin(*ids) | F.col("DOLocationID").isin(*ids)


def _airport_fee_known(service: Service) -> Column:
    return ~touches_airport(service) | F.col("airport_fee").isNotNull()


def _in_dates(service: Service, *columns: str) -> Column:
    start = F.lit(service.limits.date_from).cast("timestamp_ntz")
    end = F.lit(service.limits.date_to).cast("timestamp_ntz")
    return all_of([(F.col(c) >= start) & (F.col(c) < end) for c in columns])


def _not_negative(required=(), optional=()) -> Column:
    """Optional columns may be null: they are filled with 0 afterwards."""
    return all_of(
        [F.col(c) >= 0 for c in required]
        + [F.col(c).isNull() | (F.col(c) >= 0) for c in optional]
    )


def street_taxi_rules(service: Service, duration_limits: bool = False) -> list[Rule]:
    """Rules of metered taxis, in order. The duration rule is off unless asked for."""
    lim = service.limits
    has_airport_fee = service.name == "yellow"
    optional = ("airport_fee", "cbd_congestion_fee") if has_airport_fee else ("cbd_congestion_fee",)
    rules: list[Rule] = [("zones", _zones_known(service))]
    if has_airport_fee:
        rules.append(("airport_fee", _airport_fee_known(service)))
    rules += [
        ("dates", _in_dates(service, "pickup_datetime", "dropoff_datetime")),
        ("order", F.col("dropoff_datetime") > F.col("pickup_datetime")),
        ("miles", F.col(service.distance).between(*lim.miles)),
        ("negative", _not_negative((service.tip, service.total, "congestion_surcharge"), optional)),
        ("fare", F.col(service.fare).between(*lim.fare)),
        ("tip_cap", F.col(service.tip) <= F.col(service.fare) * lim.tip_cap),
    ]
    if duration_limits and lim.seconds:
        rules.append(
            ("seconds", seconds_between("pickup_datetime", "dropoff_datetime").between(*lim.seconds))
        )
    return rules


def app_ride_rules(service: Service) -> list[Rule]:
    """Rules of app-based rides, in order."""
    lim = service.limits
    tip = F.coalesce(F.col(service.tip), F.lit(0.0))
    return [
        ("request_time", F.col("request_datetime").isNotNull()),
        ("zones", _zones_known(service)),
        ("airport_fee", _airport_fee_known(service)),
        ("dates", _in_dates(service, "request_datetime", "pickup_datetime", "dropoff_datetime")),
        (
            "order",
            (F.col("dropoff_datetime") > F.col("pickup_datetime"))
            & (F.col("pickup_datetime") > F.col("request_datetime")),
        ),
        ("miles", F.col(service.distance).between(*lim.miles)),
        ("seconds", F.col(service.duration).between(*lim.seconds)),
        ("driver_pay", F.col("driver_pay") >= 0),
        ("fare", F.col(service.fare).between(*lim.fare)),
        ("tip_cap", (tip >= 0) & (tip <= F.col(service.fare) * lim.tip_cap)),
    ]


def rules_for(service: Service) -> list[Rule]:
    return app_ride_rules(service) if service.name == "fhvhv" else street_taxi_rules(service)


def passing(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.where(all_of([predicate for _, predicate in rules]))


def first_failed_rule(rules: list[Rule]) -> Column:
    """Name of the first rule a row breaks (null counts as broken), null if it keeps all."""
    return F.coalesce(*[F.when(~holds(predicate), F.lit(name)) for name, predicate in rules])


def rejects(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that break a rule, tagged with the first one. With ``passing`` this is all rows."""
    return df.withColumn("failed_rule", first_failed_rule(rules)).where(
        F.col("failed_rule").isNotNull()
    )


# ---- cleaning ---------------------------------------------------------------

STREET_FILLS = {"airport_fee": 0.0, "cbd_congestion_fee": 0.0}
APP_FILLS = {
    "airport_fee": 0.0, "cbd_congestion_fee": 0.0, "tips": 0.0, "tolls": 0.0,
    "sales_tax": 0.0, "congestion_surcharge": 0.0,
}


def fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.na.fill({c: v for c, v in values.items() if c in df.columns})


def impute_surcharge(df: DataFrame, service: Service, amount: float = 2.5) -> DataFrame:
    """Missing congestion surcharge: ``amount`` in the centre, 0 elsewhere."""
    in_centre = F.col("PULocationID").isin(*service.limits.cbd_zones)
    return df.withColumn(
        "congestion_surcharge",
        F.coalesce("congestion_surcharge", F.when(in_centre, amount).otherwise(0.0)),
    )


def clean_street_taxi(
    df: DataFrame, service: Service, impute: bool = False, duration_limits: bool = False
) -> DataFrame:
    """Rows that keep all rules, with missing fees as 0.

    A row without a surcharge is dropped unless ``impute`` fills it first.
    """
    if impute:
        df = impute_surcharge(df, service)
    return fill(passing(df, street_taxi_rules(service, duration_limits)), STREET_FILLS)


def clean_app_rides(df: DataFrame, service: Service) -> DataFrame:
    kept = fill(passing(df, app_ride_rules(service)), APP_FILLS)
    return kept.withColumns(
        {c: yes_flag(F.col(c)) for c in ("shared_request_flag", "shared_match_flag")}
    )


def clean(df: DataFrame, service: Service) -> DataFrame:
    return clean_app_rides(df, service) if service.name == "fhvhv" else clean_street_taxi(df, service)


def clean_geo_study(
    df: DataFrame, years: tuple[int, int], unknown_zones: tuple[int, ...] = (264, 265)
) -> DataFrame:
    """The looser rules of the origin-destination study."""
    minutes = F.col("duration_minutes")
    return df.withColumn(
        "duration_minutes", seconds_between("pickup_datetime", "dropoff_datetime") / 60
    ).where(
        (F.col("trip_distance") > 0)
        & (F.col("trip_distance") <= 50)
        & F.col("total_amount").between(2.5, 500)
        & minutes.between(1, 180)
        & F.year("pickup_datetime").between(*years)
        & F.year("dropoff_datetime").between(*years)
        & (F.col("tip_amount") >= 0)
        & (F.col("tolls_amount") >= 0)
        & ~F.col("PULocationID").isin(*unknown_zones)
        & ~F.col("DOLocationID").isin(*unknown_zones)
    )


def clean_sales(df: DataFrame, min_price_per_sqft: float = 100.0) -> DataFrame:
    """Sales with address, date, price and floor area, above a price per square foot."""
    price, area = F.col("`SALE PRICE`"), F.col("`GROSS SQUARE FEET`")
    return (
        df.where(
            F.col("ADDRESS").isNotNull()
            & F.col("`SALE DATE`").isNotNull()
            & (price > 0)
            & (area > 0)
        )
        .withColumn("price_per_sqft", price / area)
        .where(F.col("price_per_sqft") > min_price_per_sqft)
    )


# ---- study filters ----------------------------------------------------------

def work_time(df: DataFrame, service: Service, years: tuple[int, int]) -> DataFrame:
    """Weekdays from 6 to 20 h away from airports (app rides: on both ends)."""
    airports = service.limits.airports
    kept = (
        F.col("pickup_year").between(*years)
        & ~F.col("pickup_is_weekend")
        & F.col("pickup_hour").between(6, 20)
        & ~F.col("PULocationID").isin(*airports)
    )
    if service.name == "fhvhv":
        kept = kept & ~F.col("DOLocationID").isin(*airports)
    return df.where(kept)


def _no_airport(*columns: str) -> Column:
    return all_of([~F.col(c).contains("Airport") for c in columns])


def weekend_trips(df: DataFrame) -> DataFrame:
    return df.where(F.col("pickup_is_weekend") & _no_airport("pickup_zone", "dropoff_zone"))


def nightlife_out(df: DataFrame) -> DataFrame:
    """Friday and Saturday nights, not from an airport."""
    return df.where(
        (F.col("time_of_day") == "night")
        & F.col("pickup_day_name").isin("Friday", "Saturday")
        & _no_airport("pickup_zone")
    )


def nightlife_return(df: DataFrame) -> DataFrame:
    """Saturday and Sunday before dawn, neither from nor to an airport."""
    return df.where(
        (F.col("time_of_day") == "late_night")
        & (F.col("pickup_hour") < 5.5)
        & F.col("pickup_day_name").isin("Saturday", "Sunday")
        & _no_airport("pickup_zone", "dropoff_zone")
    )


def active_in_box(
    df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]
) -> DataFrame:
    """Cameras inside a box that are neither disabled nor blocked (unknown = not active)."""
    return df.where(
        F.col("Latitude").between(*lat)
        & F.col("Longitude").between(*lon)
        & (F.col("Disabled") == F.lit(False))
        & (F.col("Blocked") == F.lit(False))
    )


def feed_of_region(df: DataFrame, event_type: str, region: str) -> DataFrame:
    return df.where((F.col("EventType") == event_type) & (F.col("RegionName") == region))


def time_split(df: DataFrame, cut: str, ts: str = "pickup_datetime") -> tuple[DataFrame, DataFrame]:
    """Rows before the cut date, and from it on."""
    at = F.lit(cut).cast("timestamp_ntz")
    return df.where(F.col(ts) < at), df.where(F.col(ts) >= at)


# ---- profiles ---------------------------------------------------------------

def profile_columns(df: DataFrame, measures: dict[str, Column], value: str) -> DataFrame:
    """Count and percent of rows per named condition, in one pass over the table."""
    names = list(measures)
    one_row = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[count_if(measures[c]).alias(f"_m{i}") for i, c in enumerate(names)],
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias(value)) for i, c in enumerate(names)]
    )
    return one_row.select("_n", F.inline(pairs)).select(
        "column", value, F.coalesce(ratio(F.col(value), F.col("_n"), 100), F.lit(0.0)).alias("pct")
    )


def profile_nulls(df: DataFrame) -> DataFrame:
    return profile_columns(df, {c: F.col(f"`{c}`").isNull() for c in df.columns}, "nulls")


def profile_negatives(df: DataFrame, columns: list[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return profile_columns(df, {c: F.col(c) < 0 for c in present}, "negatives")


def profile_airport_fee(df: DataFrame, service: Service) -> DataFrame:
    """Rows without an airport fee: those at an airport go, the others are filled."""
    missing = F.col("airport_fee").isNull()
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_if(missing).alias("null_fee"),
        count_if(missing & touches_airport(service)).alias("delete_rows"),
        count_if(missing & ~touches_airport(service)).alias("fill_rows"),
    ).withColumns(
        {
            "delete_pct": ratio(F.col("delete_rows"), F.col("total_rows"), 100),
            "fill_pct": ratio(F.col("fill_rows"), F.col("total_rows"), 100),
        }
    )


def profile_wrong_rows(df: DataFrame) -> DataFrame:
    return df.agg(
        count_if(F.col("pickup_datetime") > F.col("dropoff_datetime")).alias("dropoff_before_pickup"),
        count_if(F.col("trip_distance") < 0).alias("negative_distance"),
        count_if(F.col("trip_distance") <= 0).alias("no_distance"),
        count_if(F.col("total_amount") < 2.5).alias("low_total"),
        count_if(F.col("tolls_amount") < 0).alias("negative_toll"),
        count_if(F.col("tip_amount") < 0).alias("negative_tip"),
    )


def profile_tip_rule(df: DataFrame, cap: float = 0.2) -> DataFrame:
    """Positive tips, those within the cap, and the percent a cap would remove."""
    positive = F.col("tip_amount") > 0
    within = positive & (F.col("tip_amount") <= F.col("total_amount") * cap)
    return df.agg(
        count_if(positive).alias("positive_tips"), count_if(within).alias("within_cap")
    ).withColumn(
        "removed_pct",
        ratio(F.col("positive_tips") - F.col("within_cap"), F.col("positive_tips"), 100),
    )


def profile_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per column, in one pass."""
    stats = {
        "count": lambda c: F.count(c).cast("double"),
        "mean": F.avg,
        "stddev": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    one_row = df.agg(
        *[stat(F.col(c)).alias(f"_{i}_{name}") for i, c in enumerate(columns) for name, stat in stats.items()]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}_{s}").alias(s) for s in stats])
            for i, c in enumerate(columns)
        ]
    )
    return one_row.select(F.inline(rows))


def clean_report(raw: DataFrame, rules: list[Rule], negatives: list[str]) -> DataFrame:
    """Rows before and after cleaning, percent erased, and what the kept rows still lack.

    One pass: each row is judged once by the rules.
    """
    kept = F.col("_failed").isNull()
    return (
        raw.withColumn("_failed", first_failed_rule(rules))
        .agg(
            F.count(F.lit(1)).alias("raw_rows"),
            count_if(kept).alias("clean_rows"),
            count_if(kept & F.col("airport_fee").isNull()).alias("fee_fills"),
            F.sum(
                sum((F.when(kept & (F.col(c) < 0), 1).otherwise(0) for c in negatives), F.lit(0))
            ).cast("bigint").alias("residual_negatives"),
        )
        .withColumns(
            {
                "erased_rows": F.col("raw_rows") - F.col("clean_rows"),
                "erased_pct": round_half_up(
                    ratio(F.col("raw_rows") - F.col("clean_rows"), F.col("raw_rows"), 100), 2
                ),
            }
        )
    )


def vendor_counts(raw: DataFrame, cleaned: DataFrame, vendor: str = "VendorID") -> DataFrame:
    """Rows per vendor before and after cleaning."""
    before = raw.groupBy(vendor).agg(F.count(F.lit(1)).alias("raw_trips"))
    after = cleaned.groupBy(vendor).agg(F.count(F.lit(1)).alias("clean_trips"))
    return before.join(after, vendor, "left").withColumn(
        "clean_trips", F.coalesce("clean_trips", F.lit(0))
    )
