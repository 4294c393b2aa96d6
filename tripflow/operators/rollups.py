"""Rollups by zone, time, company, borough and origin-destination pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.config import TIME_BANDS, Service
from tripflow.functions.calendar import month_label, month_start, time_band
from tripflow.functions.fares import tip_pct, trip_length_class
from tripflow.functions.numeric import count_if, ratio, round_half_up
from tripflow.operators.joins import numbered
from tripflow.operators.quantiles import exact_percentiles
from tripflow.sources.reference_data import zone_dimension

SOURCES = ("yellow", "fhvhv")
ZONE_KEYS = ("PULocationID", "pickup_borough", "pickup_zone")


def _mean(value: Column, digits: int) -> Column:
    return round_half_up(F.avg(value), digits)


# ---- zone demand ------------------------------------------------------------

def date_span(df: DataFrame, ts: str = "pickup_datetime") -> DataFrame:
    """First day, last day and number of days between them, both included."""
    return df.agg(
        F.min(F.to_date(ts)).alias("min_date"), F.max(F.to_date(ts)).alias("max_date")
    ).withColumn("n_days", (F.datediff("max_date", "min_date") + 1).cast("bigint"))


def _with_bands(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "time_band": time_band(F.hour("pickup_datetime")),
            "tip_pct": tip_pct(F.col("tips"), F.col("total_amount")),
        }
    )


# Mean -> column it is taken over and digits kept.
ZONE_MEANS = {
    "avg_fare": ("total_amount", 2),
    "avg_tip": ("tips", 2),
    "avg_tip_pct": ("tip_pct", 2),
    "avg_trip_miles": ("trip_miles", 2),
    "avg_trip_time_secs": ("trip_time", 0),
}


def _means(condition: Column | None, suffix: str) -> list[Column]:
    """Means from partial sums and counts, over all partial rows or those meeting a condition."""

    def total(name: str) -> Column:
        return F.sum(F.col(name) if condition is None else F.when(condition, F.col(name)))

    columns = []
    for name, (value, digits) in ZONE_MEANS.items():
        known = total(f"_c_{value}")
        mean = round_half_up(total(f"_s_{value}") / F.when(known != 0, known), digits)
        columns.append((mean.cast("bigint") if digits == 0 else mean).alias(name + suffix))
    return columns


def _per_day(summary: DataFrame) -> DataFrame:
    """Daily averages from the counts, with the day span of the whole table.

    The span comes from the per-zone first and last days, so the trips are not read
    again; the unpartitioned window runs over at most one row per zone.
    """
    every = Window.partitionBy()
    n_days = F.datediff(F.max("_last").over(every), F.min("_first").over(every)) + 1
    spanned = summary.withColumn("_days", n_days)
    return spanned.withColumns(
        {
            "avg_daily_pickups": round_half_up(F.col("total_trips") / F.col("_days"), 1),
            **{
                f"pickups_{band}": round_half_up(F.col(f"_{band}") / F.col("_days"), 1)
                for band in TIME_BANDS
            },
        }
    ).drop("_days", "_first", "_last", *[f"_{band}" for band in TIME_BANDS])


def _zone_summary(df: DataFrame, counts: dict[str, Column], sources: tuple[str, ...] = ()) -> DataFrame:
    """Counts, day span and means per zone, and per zone and source.

    Trips are reduced once to sums and counts per zone and source; the combined and
    the per-source figures both come from those few rows, so a trip is added up once
    and not once per figure.
    """
    counted = {**{f"_{band}": F.col("time_band") == band for band in TIME_BANDS}, **counts}
    values = [value for value, _ in ZONE_MEANS.values()]
    partial = (
        _with_bands(df)
        .groupBy(*ZONE_KEYS, *(["source"] if sources else []))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.to_date("pickup_datetime")).alias("_first"),
            F.max(F.to_date("pickup_datetime")).alias("_last"),
            *[F.sum(v).alias(f"_s_{v}") for v in values],
            *[F.count(v).alias(f"_c_{v}") for v in values],
            *[count_if(condition).alias(name) for name, condition in counted.items()],
        )
    )
    per_source = []
    for name in sources:
        of_source = F.col("source") == name
        per_source += _means(of_source, f"_{name}")
        per_source.append(F.coalesce(F.sum(F.when(of_source, F.col("_n"))), F.lit(0)).alias(f"trips_{name}"))
    return partial.groupBy(*ZONE_KEYS).agg(
        F.sum("_n").alias("total_trips"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        *_means(None, ""),
        *[F.sum(name).alias(name) for name in counted],
        *per_source,
    )


def _with_median_fare(summary: DataFrame, df: DataFrame, exact: bool) -> DataFrame:
    if exact:
        median = exact_percentiles(df, ["PULocationID"], "total_amount", {"_median": 0.5})
    else:
        median = df.groupBy("PULocationID").agg(F.percentile_approx("total_amount", 0.5).alias("_median"))
    dim = zone_dimension(median, "PULocationID", "_median")
    return summary.join(dim, "PULocationID", "left").withColumn(
        "median_fare", round_half_up(F.col("_median"), 2)
    ).drop("_median")


def zone_demand(df: DataFrame, exact_median: bool = True) -> DataFrame:
    """Demand summary per pickup zone over both services.

    Bands are conditional counts in the one aggregate, not a second grouping with a
    pivot and a join. ``exact_median=False`` takes the median from a sketch.
    """
    summary = _zone_summary(df, {}, SOURCES)
    return _with_median_fare(_per_day(summary), df, exact_median).withColumn(
        "yellow_share_pct",
        round_half_up(ratio(F.col("trips_yellow"), F.col("total_trips"), 100), 1),
    )


def zone_demand_by_service(df: DataFrame, exact_median: bool = True) -> DataFrame:
    """The summary of one service; works on trips of any single source."""
    return _with_median_fare(_per_day(_zone_summary(df, {})), df, exact_median)


def zone_demand_ses(df: DataFrame, exact_median: bool = True) -> DataFrame:
    """The summary plus trips ending in high-SES zones (needs ``is_high_SES``)."""
    summary = _zone_summary(df, {"trips_to_high_SES": F.col("is_high_SES")})
    return _with_median_fare(_per_day(summary), df, exact_median).withColumn(
        "trips_to_high_SES_pct",
        round_half_up(ratio(F.col("trips_to_high_SES"), F.col("total_trips")), 2),
    )


def pickups_by_band(df: DataFrame) -> DataFrame:
    """Trips per zone and time band as columns, none counted as 0."""
    bands = df.select("PULocationID", time_band(F.hour("pickup_datetime")).alias("time_band"))
    pivoted = bands.groupBy("PULocationID").pivot("time_band", list(TIME_BANDS)).count()
    return pivoted.select(
        "PULocationID",
        *[F.coalesce(F.col(b), F.lit(0)).alias(f"pickups_{b}") for b in TIME_BANDS],
    )


# ---- time -------------------------------------------------------------------

def yearly_trend(df: DataFrame, service: Service) -> DataFrame:
    extra = (
        _mean(F.col("company_fees"), 2).alias("avg_company_fees")
        if service.name == "fhvhv"
        else _mean(F.col(service.tip), 2).alias("avg_tip")
    )
    return df.groupBy("pickup_year").agg(
        F.count(F.lit(1)).alias("total_trips"),
        _mean(F.col(service.total), 2).alias("avg_fare"),
        _mean(F.col(service.distance), 2).alias("avg_miles"),
        round_half_up(F.avg(service.duration) / 60, 2).alias("avg_duration_min"),
        extra,
    )


def monthly_trips(df: DataFrame) -> DataFrame:
    """Volume per year-month, per year, per month of the year and in all, in one pass.

    ``level`` says which of the four a row is; the other key columns are null.
    """
    by_month = df.groupBy("pickup_year", "pickup_month").agg(F.count(F.lit(1)).alias("_n"))
    return (
        by_month.cube("pickup_year", "pickup_month")
        .agg(F.sum("_n").alias("total_trips"), F.grouping_id().alias("_g"))
        .select(
            F.element_at(
                F.array(*[F.lit(x) for x in ("year_month", "year", "month", "all")]),
                F.col("_g").cast("int") + 1,
            ).alias("level"),
            "pickup_year",
            "pickup_month",
            F.when(F.col("_g") == 0, month_start("pickup_year", "pickup_month")).alias("date"),
            "total_trips",
        )
    )


def day_of_week(df: DataFrame, service: Service) -> DataFrame:
    return df.groupBy("pickup_day_of_week", "pickup_day_name").agg(
        F.count(F.lit(1)).alias("total_trips"), _mean(F.col(service.total), 2).alias("avg_fare")
    )


def hourly_demand(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("pickup_hour", "pickup_is_weekend")
        .agg(F.count(F.lit(1)).alias("total_trips"))
        .withColumn("day_type", F.when(F.col("pickup_is_weekend"), "Weekend").otherwise("Weekday"))
    )


def time_of_day_demand(df: DataFrame, service: Service) -> DataFrame:
    """Volume and mean fare per time of day; app rides also give the mean wait."""
    wait = (
        [_mean(F.col("wait_time") / 60.0, 2).alias("avg_wait_min")]
        if service.name == "fhvhv"
        else []
    )
    return df.groupBy("time_of_day").agg(
        F.count(F.lit(1)).alias("total_trips"),
        _mean(F.col(service.total), 2).alias("avg_fare"),
        *wait,
    )


def heatmap_hour_dow(df: DataFrame) -> DataFrame:
    """Weekday rows, one column per hour."""
    counts = df.groupBy("pickup_day_of_week", "pickup_day_name").pivot("pickup_hour", list(range(24))).count()
    return counts.select(
        "pickup_day_of_week",
        "pickup_day_name",
        *[F.coalesce(F.col(f"`{h}`"), F.lit(0)).alias(f"h{h:02d}") for h in range(24)],
    )


def market_share(df: DataFrame) -> DataFrame:
    """Trips, mean fee and share of the month per company."""
    monthly = df.groupBy("pickup_year", "pickup_month", "company").agg(
        F.count(F.lit(1)).alias("trips"), _mean(F.col("company_fees"), 2).alias("avg_company_fees")
    )
    month = Window.partitionBy("pickup_year", "pickup_month")
    return monthly.withColumn("total", F.sum("trips").over(month)).withColumns(
        {
            "share_pct": round_half_up(F.col("trips") / F.col("total") * 100, 2),
            "date": month_start("pickup_year", "pickup_month"),
        }
    )


def wait_trend(df: DataFrame, exact: bool = True) -> DataFrame:
    """Mean, median and 90th percentile of the wait in minutes per month.

    Percentiles are taken over whole seconds, which collapse well before the shuffle.
    """
    keys = ["pickup_year", "pickup_month"]
    waiting = df.where(F.col("wait_time") > 0)
    mean = _mean(F.col("wait_time") / 60.0, 2).alias("avg_wait")

    def minutes(c):
        return round_half_up(c / 60.0, 2)

    if not exact:
        return waiting.groupBy(*keys).agg(
            mean,
            minutes(F.percentile_approx("wait_time", 0.5)).alias("median_wait"),
            minutes(F.percentile_approx("wait_time", 0.9)).alias("p90_wait"),
        )
    cuts = exact_percentiles(waiting, keys, "wait_time", {"_p50": 0.5, "_p90": 0.9})
    return (
        waiting.groupBy(*keys)
        .agg(mean)
        .join(cuts, keys)
        .select(
            *keys,
            "avg_wait",
            minutes(F.col("_p50")).alias("median_wait"),
            minutes(F.col("_p90")).alias("p90_wait"),
        )
    )


def borough_monthly(df: DataFrame) -> DataFrame:
    return df.groupBy("pickup_year", "pickup_month", "pickup_borough").agg(
        F.count(F.lit(1)).alias("trips")
    )


# ---- tips -------------------------------------------------------------------

def borough_tips(df: DataFrame, service: Service) -> DataFrame:
    return df.groupBy("pickup_year", "pickup_month", "pickup_borough").agg(
        _mean(F.col(service.tip), 2).alias("avg_tip")
    )


def od_tip_matrix(df: DataFrame, service: Service, boroughs: list[str], min_trips: int = 10) -> DataFrame:
    """Mean tip by pickup borough (rows) and dropoff borough (columns).

    Pairs with ``min_trips`` trips or fewer, and pairs without trips, show 0. A pickup
    borough all of whose pairs are too small has no row.
    """
    pairs = (
        df.groupBy("pickup_borough", "dropoff_borough")
        .agg(F.avg(service.tip).alias("avg_tip"), F.count(F.lit(1)).alias("trips"))
        .where(F.col("trips") > min_trips)
    )
    matrix = pairs.groupBy("pickup_borough").pivot("dropoff_borough", boroughs).agg(F.first("avg_tip"))
    return matrix.na.fill(0.0, subset=boroughs)


def _share_tipped(tip: str) -> Column:
    return round_half_up(count_if(F.col(tip) > 0) / F.count(F.lit(1)) * 100, 1)


def tips_monthly(df: DataFrame, service: Service) -> DataFrame:
    """Mean tip, percent of trips with a tip and mean tip rate per month."""
    tip, fare = F.col(service.tip), F.col(service.fare)
    return df.groupBy("pickup_year", "pickup_month").agg(
        _mean(tip, 2).alias("avg_tip"),
        _share_tipped(service.tip).alias("pct_tipped"),
        _mean(F.when(fare > 0, tip / fare * 100), 2).alias("avg_tip_rate"),
    )


def tips_by_company(df: DataFrame, service: Service) -> DataFrame:
    return df.groupBy("pickup_year", "pickup_month", "company").agg(
        _mean(F.col(service.tip), 2).alias("avg_tip"),
        _share_tipped(service.tip).alias("pct_tipped"),
    )


# ---- zones and boroughs -----------------------------------------------------

def hourly_by(df: DataFrame, area: str, side: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Trips per hour and zone or borough, on the pickup or the dropoff side."""
    kept = df.where(F.col(f"{side}_year").between(*years)) if years else df
    return kept.groupBy(f"{side}_hour", f"{side}_{area}").agg(
        F.count(F.lit(1)).alias("trips_per_hour")
    )


def zone_period(df: DataFrame, side: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Year-month-zone, year-zone and year-borough counts in one pass.

    Trips are first counted per year, month and zone; the three groupings expand
    those counts only.
    """
    kept = df.where(F.col(f"{side}_year").between(*years)) if years else df
    year, month, zone, borough = (f"{side}_{x}" for x in ("year", "month", "zone", "borough"))
    counts = kept.groupBy(year, month, zone, borough).agg(F.count(F.lit(1)).alias("_n"))
    sets = [[F.col(year), F.col(month), F.col(zone)], [F.col(year), F.col(zone)], [F.col(year), F.col(borough)]]
    return (
        counts.groupingSets(sets, F.col(year), F.col(month), F.col(zone), F.col(borough))
        .agg(F.sum("_n").alias("trips"), F.grouping(month).alias("_gm"), F.grouping(zone).alias("_gz"))
        .select(
            F.when(F.col("_gm") == 0, "year_month_zone")
            .when(F.col("_gz") == 0, "year_zone")
            .otherwise("year_borough")
            .alias("level"),
            year,
            month,
            zone,
            borough,
            F.when(F.col("_gm") == 0, month_label(year, month)).alias("year_month"),
            "trips",
        )
    )


def share_of_hour(df: DataFrame) -> DataFrame:
    """Each borough's share of the trips of an hour, by a window over the counts."""
    counts = df.groupBy("pickup_hour", "pickup_borough").agg(F.count(F.lit(1)).alias("trips_per_hour"))
    share = F.col("trips_per_hour") / F.sum("trips_per_hour").over(Window.partitionBy("pickup_hour"))
    return counts.withColumn("proportion", share).withColumn("percentage", F.col("proportion") * 100)


def leisure_zones(
    df: DataFrame, side: str = "pickup", boroughs: tuple[str, str] | None = None
) -> DataFrame:
    """Trips per pickup hour and zone of either side, optionally between two boroughs."""
    if boroughs:
        df = df.where(
            (F.col("pickup_borough") == boroughs[0]) & (F.col("dropoff_borough") == boroughs[1])
        )
    return df.groupBy("pickup_hour", f"{side}_zone").agg(F.count(F.lit(1)).alias("trips_per_hour"))


def cost_by_zone_hour(df: DataFrame, service: Service, side: str = "pickup") -> DataFrame:
    """Cost and distance per trip length class, hour and zone, for trips under 10 miles.

    Every class has its own fare cap. The hour is the pickup hour, for app rides the
    hour of the request.
    """
    distance, total = F.col(service.distance), F.col(service.total)
    if service.cost_hour == "request_hour":
        df = df.withColumn("request_hour", F.hour("request_datetime"))
    if service.cost_years:
        df = df.where(F.col("pickup_year").between(*service.cost_years))
    length = F.col("length_class")
    short, medium, long = service.cost_caps
    under_cap = (
        (length == "long")
        | ((length == "short") & (total < short))
        | ((length == "medium") & (total < medium))
    )
    if long is not None:
        under_cap = under_cap & ((length != "long") | (total < long))
    return (
        df.where(distance < 10)
        .withColumn("length_class", trip_length_class(distance, service.length_cuts))
        .where(under_cap)
        .groupBy("length_class", service.cost_hour, f"{side}_zone")
        .agg(
            F.sum(total).alias("total_amount_hour"),
            F.count(F.lit(1)).alias("n_trips"),
            F.max(total).alias("max_cost"),
            F.sum(distance).alias("total_distance_hour"),
        )
        .withColumns(
            {
                "avg_cost": F.col("total_amount_hour") / F.col("n_trips"),
                "avg_distance": F.col("total_distance_hour") / F.col("n_trips"),
            }
        )
    )


def od_flows(
    df: DataFrame, origin: str = "pickup_zone", target: str = "dropoff_zone", n: int | None = 35
) -> DataFrame:
    """Trips per origin-destination pair with the percent of all trips; the top ``n``."""
    pairs = df.groupBy(origin, target).agg(F.count(F.lit(1)).alias("trips"))
    shared = pairs.withColumn("pct_of_all", F.col("trips") / pairs.agg(F.sum("trips")).scalar() * 100)
    if n is None:
        return shared
    return shared.orderBy(F.desc("trips"), origin, target).limit(n)


def busiest(df: DataFrame, area: list[str], n: int = 10) -> DataFrame:
    return (
        df.groupBy(*area)
        .agg(F.count(F.lit(1)).alias("trips"))
        .orderBy(F.desc("trips"), *area)
        .limit(n)
    )


def flow_nodes(df: DataFrame, origin: str, target: str) -> DataFrame:
    """Distinct places of both ends with a source id (0..n-1) and a target id (n..2n-1).

    Ids follow the alphabet, numbered by ranges of labels.
    """
    pairs = df.select(origin, target).distinct()
    labels = (
        pairs.select(F.col(origin).alias("label"))
        .union(pairs.select(F.col(target).alias("label")))
        .where(F.col("label").isNotNull())
        .distinct()
    )
    nodes = numbered(labels, "label", "source_id")
    count = nodes.agg(F.count(F.lit(1))).scalar()
    return nodes.withColumns({"source_id": F.col("source_id").cast("int"), "target_id": (F.col("source_id") + count).cast("int")})


def flow_links(df: DataFrame, origin: str, target: str, n: int | None = 35) -> DataFrame:
    """The top flows between numbered nodes, as a flow chart needs them."""
    top = od_flows(df, origin, target, n)
    nodes = flow_nodes(top, origin, target)
    sources = nodes.select(F.col("label").alias(origin), "source_id")
    targets = nodes.select(F.col("label").alias(target), "target_id")
    return top.join(sources, origin).join(targets, target)


def rain_demand(df: DataFrame, threshold: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From hourly counts with ``rain_class``: trips per class, mean trips per hour of day,
    zone and class above a threshold, and mean trips per hour of day and class.

    Means are over observed zone-hours only.
    """
    totals = df.groupBy("rain_class").agg(F.sum("trips").alias("trips"))
    hour = F.hour("hour").alias("hour_of_day")
    by_zone = (
        df.groupBy("rain_class", hour, "zone_id")
        .agg(F.avg("trips").alias("avg_trips"))
        .where(F.col("avg_trips") > threshold)
    )
    by_hour = df.groupBy("rain_class", hour).agg(F.avg("trips").alias("avg_trips"))
    return totals, by_zone, by_hour
