"""Registered rollups: zone demand, time, tips, zones, origin-destination, weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.config import TIME_BANDS
from tripflow.operators import enrich, quality, rollups, tip_ranges
from tripflow.functions import fares
from tripflow.functions.numeric import round_half_up
from tripflow.plans import inputs
from tripflow.plans.check_sql import demand_sql, query, r
from tripflow.plans.inputs import FHVHV_CITY, FHVHV_YEARS, YELLOW_CITY, YELLOW_YEARS
from tripflow.plans.registry import register


def rounded(df, **digits):
    """Unrounded float results rounded for the comparison of two engines."""
    return df.withColumns({c: round_half_up(F.col(c), d) for c, d in digits.items()})


def dates_as_text(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


@register("zone_demand", query("SELECT * FROM zone_demand"))
def zone_demand(spark, sf):
    return rollups.zone_demand(inputs.all_trips(spark, sf))


BY_SERVICE_COLUMNS = (
    "PULocationID, pickup_borough, pickup_zone, total_trips, avg_daily_pickups, median_fare, avg_fare, avg_tip, "
    "avg_tip_pct, avg_trip_miles, avg_trip_time_secs, pickups_morning, pickups_afternoon, pickups_evening, pickups_night"
)


@register(
    "zone_demand_by_service",
    query(
        f"SELECT 'yellow' AS service, {BY_SERVICE_COLUMNS} FROM demand_y UNION ALL SELECT 'fhvhv', {BY_SERVICE_COLUMNS} FROM demand_f",
        {
            "only_y": "SELECT * FROM all_trips WHERE source = 'yellow'",
            "only_f": "SELECT * FROM all_trips WHERE source = 'fhvhv'",
            "demand_y": demand_sql("only_y", False),
            "demand_f": demand_sql("only_f", False),
        },
    ),
)
def zone_demand_by_service(spark, sf):
    trips = inputs.all_trips(spark, sf)
    parts = [
        rollups.zone_demand_by_service(trips.where(F.col("source") == s)).withColumn("service", F.lit(s))
        for s in rollups.SOURCES
    ]
    return parts[0].unionByName(parts[1])


@register(
    "date_span",
    query(
        "SELECT strftime(min(pickup_datetime), '%Y-%m-%d') AS min_date, strftime(max(pickup_datetime), '%Y-%m-%d') AS max_date, "
        "date_diff('day', min(CAST(pickup_datetime AS DATE)), max(CAST(pickup_datetime AS DATE))) + 1 AS n_days FROM all_trips"
    ),
)
def date_span(spark, sf):
    return dates_as_text(rollups.date_span(inputs.all_trips(spark, sf)), "min_date", "max_date")


@register(
    "pickups_by_band",
    query(
        "SELECT PULocationID, "
        + ", ".join(f"count(*) FILTER (WHERE hour(pickup_datetime) BETWEEN {a} AND {b}) AS pickups_{n}" for n, (a, b) in TIME_BANDS.items())
        + " FROM all_trips GROUP BY 1"
    ),
)
def pickups_by_band(spark, sf):
    return rollups.pickups_by_band(inputs.all_trips(spark, sf))


def yearly_sql(trips, distance, extra):
    return (
        f"SELECT pickup_year, count(*) AS total_trips, {r('avg(total_amount)', 2)} AS avg_fare, {r(f'avg({distance})', 2)} AS avg_miles, "
        f"{r('avg(trip_time) / 60', 2)} AS avg_duration_min, {extra} FROM {trips} GROUP BY 1"
    )


@register(
    "yearly_trend",
    query(yearly_sql("fhvhv_trips", "trip_miles", f"{r('avg(company_fees)', 2)} AS avg_company_fees")),
)
def yearly_trend(spark, sf):
    return rollups.yearly_trend(inputs.fhvhv_rides(spark, sf), FHVHV_CITY)


@register(
    "yearly_trend_yellow",
    query(yearly_sql("yellow_trips", "trip_distance", f"{r('avg(tip_amount)', 2)} AS avg_tip")),
)
def yearly_trend_yellow(spark, sf):
    return rollups.yearly_trend(inputs.yellow_trips(spark, sf), YELLOW_CITY)


@register(
    "yearly_trend_green",
    query(yearly_sql("green_trips", "trip_distance", f"{r('avg(tip_amount)', 2)} AS avg_tip")),
)
def yearly_trend_green(spark, sf):
    return rollups.yearly_trend(inputs.green_trips(spark, sf), inputs.GREEN_CITY)


@register(
    "monthly_trips",
    query(
        "SELECT CASE grouping(pickup_year) * 2 + grouping(pickup_month) WHEN 0 THEN 'year_month' WHEN 1 THEN 'year' WHEN 2 THEN 'month' ELSE 'all' END AS level, "
        "pickup_year, pickup_month, CASE WHEN grouping(pickup_year) + grouping(pickup_month) = 0 THEN strftime(make_date(pickup_year, pickup_month, 1), '%Y-%m-%d') END AS date, "
        "count(*) AS total_trips FROM fhvhv_trips GROUP BY CUBE (pickup_year, pickup_month)"
    ),
)
def monthly_trips(spark, sf):
    return dates_as_text(rollups.monthly_trips(inputs.fhvhv_rides(spark, sf)), "date")


@register(
    "dow_demand",
    query(f"SELECT pickup_day_of_week, pickup_day_name, count(*) AS total_trips, {r('avg(total_amount)', 2)} AS avg_fare FROM fhvhv_trips GROUP BY 1, 2"),
)
def dow_demand(spark, sf):
    return rollups.day_of_week(inputs.fhvhv_rides(spark, sf), FHVHV_CITY)


@register(
    "hourly_demand",
    query("SELECT pickup_hour, pickup_is_weekend, count(*) AS total_trips, CASE WHEN pickup_is_weekend THEN 'Weekend' ELSE 'Weekday' END AS day_type FROM yellow_trips GROUP BY ALL"),
)
def hourly_demand(spark, sf):
    return rollups.hourly_demand(inputs.yellow_trips(spark, sf))


@register(
    "tod_demand",
    query(f"SELECT time_of_day, count(*) AS total_trips, {r('avg(total_amount)', 2)} AS avg_fare, {r('avg(wait_time / 60.0)', 2)} AS avg_wait_min FROM fhvhv_trips GROUP BY 1"),
)
def tod_demand(spark, sf):
    return rollups.time_of_day_demand(inputs.fhvhv_rides(spark, sf), FHVHV_CITY)


@register(
    "heatmap_hour_dow",
    query(
        "SELECT pickup_day_of_week, pickup_day_name, "
        + ", ".join(f"count(*) FILTER (WHERE pickup_hour = {h}) AS h{h:02d}" for h in range(24))
        + " FROM yellow_trips GROUP BY 1, 2"
    ),
)
def heatmap_hour_dow(spark, sf):
    return rollups.heatmap_hour_dow(inputs.yellow_trips(spark, sf))


@register(
    "market_share",
    query(
        f"SELECT *, {r('trips / total * 100', 2)} AS share_pct, strftime(make_date(pickup_year, pickup_month, 1), '%Y-%m-%d') AS date FROM ("
        f"SELECT pickup_year, pickup_month, company, count(*) AS trips, {r('avg(company_fees)', 2)} AS avg_company_fees, "
        "CAST(sum(count(*)) OVER (PARTITION BY pickup_year, pickup_month) AS BIGINT) AS total FROM fhvhv_trips GROUP BY 1, 2, 3)"
    ),
)
def market_share(spark, sf):
    return dates_as_text(rollups.market_share(inputs.fhvhv_rides(spark, sf)), "date")


@register(
    "wait_trend",
    query(
        f"SELECT pickup_year, pickup_month, {r('avg(wait_time / 60.0)', 2)} AS avg_wait, {r('quantile_disc(wait_time, 0.5) / 60.0', 2)} AS median_wait, "
        f"{r('quantile_disc(wait_time, 0.9) / 60.0', 2)} AS p90_wait FROM fhvhv_trips WHERE wait_time > 0 GROUP BY 1, 2"
    ),
)
def wait_trend(spark, sf):
    return rollups.wait_trend(inputs.fhvhv_rides(spark, sf))


@register(
    "borough_monthly",
    query("SELECT pickup_year, pickup_month, pickup_borough, count(*) AS trips FROM fhvhv_trips GROUP BY 1, 2, 3"),
)
def borough_monthly(spark, sf):
    return rollups.borough_monthly(inputs.fhvhv_rides(spark, sf))


@register(
    "borough_tips",
    query(f"SELECT pickup_year, pickup_month, pickup_borough, {r('avg(tip_amount)', 2)} AS avg_tip FROM yellow_trips GROUP BY 1, 2, 3"),
)
def borough_tips(spark, sf):
    return rollups.borough_tips(inputs.yellow_trips(spark, sf), YELLOW_CITY)


BOROUGHS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@register(
    "od_tip_matrix",
    query(
        "SELECT pickup_borough, "
        + ", ".join(f"{r(f'''coalesce(max(a) FILTER (WHERE dropoff_borough = '{b}'), 0)''', 6)} AS \"{b}\"" for b in BOROUGHS)
        + " FROM (SELECT pickup_borough, dropoff_borough, avg(tip_amount) AS a, count(*) AS n FROM yellow_trips GROUP BY 1, 2 HAVING count(*) > 10) GROUP BY 1"
    ),
)
def od_tip_matrix(spark, sf):
    matrix = rollups.od_tip_matrix(inputs.yellow_trips(spark, sf), YELLOW_CITY, BOROUGHS)
    return matrix.select("pickup_borough", *[round_half_up(F.col(f"`{b}`"), 6).alias(b) for b in BOROUGHS])


def tips_monthly_sql(trips, tip, fare):
    return (
        f"SELECT pickup_year, pickup_month, {r(f'avg({tip})', 2)} AS avg_tip, {r(f'count(*) FILTER (WHERE {tip} > 0) / count(*) * 100', 1)} AS pct_tipped, "
        f"{r(f'avg(CASE WHEN {fare} > 0 THEN {tip} / {fare} * 100 END)', 2)} AS avg_tip_rate FROM {trips} GROUP BY 1, 2"
    )


@register("tips_monthly", query(tips_monthly_sql("yellow_trips", "tip_amount", "total_amount")))
def tips_monthly(spark, sf):
    return rollups.tips_monthly(inputs.yellow_trips(spark, sf), YELLOW_CITY)


@register("tips_monthly_fhvhv", query(tips_monthly_sql("fhvhv_trips", "tips", "base_passenger_fare")))
def tips_monthly_fhvhv(spark, sf):
    return rollups.tips_monthly(inputs.fhvhv_rides(spark, sf), FHVHV_CITY)


@register(
    "tips_by_company",
    query(f"SELECT pickup_year, pickup_month, company, {r('avg(tips)', 2)} AS avg_tip, {r('count(*) FILTER (WHERE tips > 0) / count(*) * 100', 1)} AS pct_tipped FROM fhvhv_trips GROUP BY 1, 2, 3"),
)
def tips_by_company(spark, sf):
    return rollups.tips_by_company(inputs.fhvhv_rides(spark, sf), FHVHV_CITY)


RANGE_5 = "CASE WHEN p < 5 THEN '0-5%' WHEN p < 10 THEN '5-10%' WHEN p < 15 THEN '10-15%' WHEN p < 20 THEN '15-20%' ELSE '20-25%' END"
ORDER_5 = "CASE WHEN p < 5 THEN 1 WHEN p < 10 THEN 2 WHEN p < 15 THEN 3 WHEN p < 20 THEN 4 ELSE 5 END"
RANGE_7 = (
    "CASE WHEN p < 5 THEN '0-5%' WHEN p < 10 THEN '5-10%' WHEN p < 15 THEN '10-15%' WHEN p < 20 THEN '15-20%' "
    "WHEN p < 25 THEN '20-25%' WHEN p < 30 THEN '25-30%' ELSE '30-50%' END"
)
ORDER_7 = "CASE WHEN p < 5 THEN 1 WHEN p < 10 THEN 2 WHEN p < 15 THEN 3 WHEN p < 20 THEN 4 WHEN p < 25 THEN 5 WHEN p < 30 THEN 6 ELSE 7 END"


def tip_dist_sql(trips, tip, fare, names, order, bounded):
    kept = " AND p BETWEEN 0 AND 25" if bounded else ""
    return (
        f"SELECT {names} AS percentage_range, CAST({order} AS INT) AS range_order, count(*) AS trips, "
        f"{r('count(*) / sum(count(*)) OVER () * 100', 6)} AS pct "
        f"FROM (SELECT *, {tip} / {fare} * 100 AS p FROM {trips} WHERE {fare} > 0) WHERE true{kept} GROUP BY 1, 2"
    )


@register("tip_dist", query(tip_dist_sql("yellow_trips", "tip_amount", "total_amount", RANGE_5, ORDER_5, True)))
def tip_dist(spark, sf):
    return rounded(tip_ranges.tip_distribution(inputs.yellow_trips(spark, sf), YELLOW_CITY), pct=6)


@register("tip_dist_fhvhv", query(tip_dist_sql("fhvhv_trips", "tips", "base_passenger_fare", RANGE_7, ORDER_7, False)))
def tip_dist_fhvhv(spark, sf):
    return rounded(tip_ranges.tip_distribution(inputs.fhvhv_rides(spark, sf), FHVHV_CITY), pct=6)


@register(
    "tip_pct_ranges",
    query(
        f"SELECT pickup_zone, {RANGE_7} AS percentage_range, count(*) AS trips, {r('min(p)', 6)} AS min_pct, {r('max(p)', 6)} AS max_pct "
        "FROM (SELECT *, tips / base_passenger_fare * 100 AS p FROM fhvhv_trips WHERE base_passenger_fare > 0) GROUP BY 1, 2"
    ),
)
def tip_pct_ranges(spark, sf):
    ranged = tip_ranges.with_tip_pct_range(inputs.fhvhv_rides(spark, sf), FHVHV_CITY, bounded=False)
    pct = F.col("tip_percentage")
    return ranged.groupBy("pickup_zone", "percentage_range").agg(
        F.count(F.lit(1)).alias("trips"),
        round_half_up(F.min(pct), 6).alias("min_pct"),
        round_half_up(F.max(pct), 6).alias("max_pct"),
    )


@register(
    "tip_dist_borough",
    query(
        f"SELECT pickup_borough, {RANGE_5} AS percentage_range, CAST({ORDER_5} AS INT) AS range_order, count(*) AS trips, "
        "CAST(sum(count(*)) OVER (PARTITION BY pickup_borough) AS BIGINT) AS total_trips, "
        f"{r('count(*) / sum(count(*)) OVER (PARTITION BY pickup_borough) * 100', 6)} AS percentage_of_borough "
        "FROM (SELECT *, tip_amount / total_amount * 100 AS p FROM yellow_trips WHERE total_amount > 0) GROUP BY 1, 2, 3"
    ),
)
def tip_dist_borough(spark, sf):
    return rounded(
        tip_ranges.tip_distribution_by_borough(inputs.yellow_trips(spark, sf), YELLOW_CITY),
        percentage_of_borough=6,
    )


@register(
    "tip_dist_usd",
    query(
        "SELECT ['$0', '$1-2', '$2-3', '$3-5', '$5+'][tip_category + 1] AS tip_range, CAST(tip_category + 1 AS INT) AS range_order, "
        "count(*) AS trips FROM yellow_trips WHERE total_amount > 0 GROUP BY 1, 2"
    ),
)
def tip_dist_usd(spark, sf):
    return tip_ranges.tip_distribution_usd(inputs.yellow_trips(spark, sf), YELLOW_CITY)


# ---- zones and boroughs -----------------------------------------------------

@register(
    "zone_hour",
    query("SELECT pickup_hour, pickup_zone, count(*) AS trips_per_hour FROM yellow_trips WHERE pickup_year BETWEEN 2023 AND 2025 GROUP BY 1, 2"),
)
def zone_hour(spark, sf):
    return rollups.hourly_by(inputs.yellow_trips(spark, sf), "zone", "pickup", YELLOW_YEARS)


@register(
    "borough_hour",
    query(
        "SELECT CAST(hour(dropoff_datetime) AS INT) AS dropoff_hour, dropoff_borough, count(*) AS trips_per_hour FROM yellow_trips "
        "WHERE year(dropoff_datetime) BETWEEN 2023 AND 2025 GROUP BY 1, 2"
    ),
)
def borough_hour(spark, sf):
    from tripflow.functions.calendar import add_calendar

    trips = add_calendar(inputs.yellow_trips(spark, sf), "dropoff")
    return rollups.hourly_by(trips, "borough", "dropoff", YELLOW_YEARS)


@register(
    "zone_period",
    query(
        "SELECT CASE WHEN grouping(pickup_month) = 0 THEN 'year_month_zone' WHEN grouping(pickup_zone) = 0 THEN 'year_zone' ELSE 'year_borough' END AS level, "
        "pickup_year, pickup_month, pickup_zone, pickup_borough, "
        "CASE WHEN grouping(pickup_month) = 0 THEN pickup_year || '-' || lpad(CAST(pickup_month AS VARCHAR), 2, '0') END AS year_month, count(*) AS trips "
        "FROM fhvhv_trips WHERE pickup_year BETWEEN 1996 AND 2000 "
        "GROUP BY GROUPING SETS ((pickup_year, pickup_month, pickup_zone), (pickup_year, pickup_zone), (pickup_year, pickup_borough))"
    ),
)
def zone_period(spark, sf):
    return rollups.zone_period(inputs.fhvhv_rides(spark, sf), "pickup", FHVHV_YEARS)


WORK = "NOT pickup_is_weekend AND pickup_hour BETWEEN 6 AND 20 AND PULocationID NOT IN (1, 2, 3)"


@register(
    "filter_work_time",
    query(
        f"SELECT 'yellow' AS service, pickup_zone, count(*) AS trips FROM yellow_trips WHERE pickup_year BETWEEN 2023 AND 2025 AND {WORK} GROUP BY 2 "
        f"UNION ALL SELECT 'fhvhv', pickup_zone, count(*) FROM fhvhv_trips WHERE pickup_year BETWEEN 1996 AND 2000 AND {WORK} AND DOLocationID NOT IN (1, 2, 3) GROUP BY 2"
    ),
)
def filter_work_time(spark, sf):
    parts = [
        quality.work_time(inputs.yellow_trips(spark, sf), YELLOW_CITY, YELLOW_YEARS).select(F.lit("yellow").alias("service"), "pickup_zone"),
        quality.work_time(inputs.fhvhv_rides(spark, sf), FHVHV_CITY, FHVHV_YEARS).select(F.lit("fhvhv").alias("service"), "pickup_zone"),
    ]
    return parts[0].unionByName(parts[1]).groupBy("service", "pickup_zone").agg(F.count(F.lit(1)).alias("trips"))


@register(
    "share_of_hour",
    query(
        "SELECT pickup_hour, pickup_borough, trips_per_hour, "
        f"{r('trips_per_hour / sum(trips_per_hour) OVER (PARTITION BY pickup_hour)', 8)} AS proportion, "
        f"{r('trips_per_hour / sum(trips_per_hour) OVER (PARTITION BY pickup_hour) * 100', 6)} AS percentage "
        f"FROM (SELECT pickup_hour, pickup_borough, count(*) AS trips_per_hour FROM yellow_trips WHERE {WORK} GROUP BY 1, 2)"
    ),
)
def share_of_hour(spark, sf):
    trips = quality.work_time(inputs.yellow_trips(spark, sf), YELLOW_CITY, YELLOW_YEARS)
    return rounded(rollups.share_of_hour(trips), proportion=8, percentage=6)


NO_AIRPORT = "pickup_zone NOT LIKE '%Airport%' AND dropoff_zone NOT LIKE '%Airport%'"


@register(
    "filter_nightlife",
    query(
        f"SELECT 'weekend' AS kind, count(*) AS trips, {r('sum(total_amount)', 2)} AS paid FROM yellow_trips WHERE pickup_is_weekend AND {NO_AIRPORT} UNION ALL "
        f"SELECT 'go', count(*), {r('sum(total_amount)', 2)} FROM yellow_trips WHERE time_of_day = 'night' AND pickup_day_name IN ('Friday', 'Saturday') AND pickup_zone NOT LIKE '%Airport%' UNION ALL "
        f"SELECT 'return', count(*), {r('sum(total_amount)', 2)} FROM yellow_trips WHERE time_of_day = 'late_night' AND pickup_hour < 5.5 AND pickup_day_name IN ('Saturday', 'Sunday') AND {NO_AIRPORT}"
    ),
)
def filter_nightlife(spark, sf):
    trips = inputs.yellow_trips(spark, sf)
    kinds = {
        "weekend": quality.weekend_trips(trips),
        "go": quality.nightlife_out(trips),
        "return": quality.nightlife_return(trips),
    }
    parts = [
        df.agg(
            F.lit(kind).alias("kind"),
            F.count(F.lit(1)).alias("trips"),
            round_half_up(F.sum("total_amount"), 2).alias("paid"),
        )
        for kind, df in kinds.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "leisure_zones",
    query(
        "SELECT 'go' AS kind, pickup_hour, dropoff_zone AS zone, count(*) AS trips_per_hour FROM yellow_trips WHERE time_of_day = 'night' AND pickup_day_name IN ('Friday', 'Saturday') AND pickup_zone NOT LIKE '%Airport%' GROUP BY 2, 3 "
        f"UNION ALL SELECT 'weekend', pickup_hour, pickup_zone, count(*) FROM yellow_trips WHERE pickup_is_weekend AND {NO_AIRPORT} AND pickup_borough = 'ASIA' AND dropoff_borough = 'ASIA' GROUP BY 2, 3"
    ),
)
def leisure_zones(spark, sf):
    trips = inputs.yellow_trips(spark, sf)
    out = rollups.leisure_zones(quality.nightlife_out(trips), "dropoff")
    weekend = rollups.leisure_zones(quality.weekend_trips(trips), "pickup", ("ASIA", "ASIA"))
    return out.select(F.lit("go").alias("kind"), "pickup_hour", F.col("dropoff_zone").alias("zone"), "trips_per_hour").unionByName(
        weekend.select(F.lit("weekend").alias("kind"), "pickup_hour", F.col("pickup_zone").alias("zone"), "trips_per_hour")
    )


def cost_sql(trips, distance, hour, cuts, caps, extra):
    return (
        f"SELECT length_class, {hour}, pickup_zone, {r('sum(total_amount)', 2)} AS total_amount_hour, count(*) AS n_trips, {r('max(total_amount)', 2)} AS max_cost, "
        f"{r(f'sum({distance})', 2)} AS total_distance_hour, {r('sum(total_amount) / count(*)', 6)} AS avg_cost, {r(f'sum({distance}) / count(*)', 6)} AS avg_distance "
        f"FROM (SELECT *, CASE WHEN {distance} < {cuts[0]} THEN 'short' WHEN {distance} < {cuts[1]} THEN 'medium' ELSE 'long' END AS length_class FROM ({trips}) WHERE {distance} < 10 {extra}) "
        f"WHERE CASE length_class WHEN 'short' THEN total_amount < {caps[0]} WHEN 'medium' THEN total_amount < {caps[1]} ELSE true END GROUP BY 1, 2, 3"
    )


COST_DIGITS = dict(total_amount_hour=2, max_cost=2, total_distance_hour=2, avg_cost=6, avg_distance=6)


@register(
    "cost_by_zone_hour",
    query(cost_sql("SELECT * FROM yellow_trips", "trip_distance", "pickup_hour", (1.5, 5), (35, 65), "AND pickup_year BETWEEN 2023 AND 2025")),
)
def cost_by_zone_hour(spark, sf):
    return rounded(rollups.cost_by_zone_hour(inputs.yellow_trips(spark, sf), YELLOW_CITY), **COST_DIGITS)


@register(
    "cost_by_request_hour",
    query(cost_sql("SELECT *, CAST(hour(request_datetime) AS INT) AS request_hour FROM fhvhv_trips", "trip_miles", "request_hour", (1.5, 6), (50, 100), "")),
)
def cost_by_request_hour(spark, sf):
    return rounded(rollups.cost_by_zone_hour(inputs.fhvhv_rides(spark, sf), FHVHV_CITY), **COST_DIGITS)


@register(
    "trip_length_class",
    query(
        "SELECT CASE WHEN trip_distance < 1.5 THEN 'short' WHEN trip_distance < 5 THEN 'medium' ELSE 'long' END AS length_class, "
        f"count(*) AS trips, {r('avg(trip_distance)', 6)} AS avg_miles FROM yellow_trips GROUP BY 1"
    ),
)
def trip_length_class(spark, sf):
    trips = inputs.yellow_trips(spark, sf)
    return trips.groupBy(fares.trip_length_class(F.col("trip_distance"), YELLOW_CITY.length_cuts).alias("length_class")).agg(
        F.count(F.lit(1)).alias("trips"), round_half_up(F.avg("trip_distance"), 6).alias("avg_miles")
    )


# ---- origin-destination -----------------------------------------------------

@register(
    "od_flows",
    query(
        f"SELECT pickup_zone, dropoff_zone, count(*) AS trips, {r('count(*) / sum(count(*)) OVER () * 100', 6)} AS pct_of_all "
        "FROM fhvhv_trips GROUP BY 1, 2 ORDER BY trips DESC, pickup_zone, dropoff_zone LIMIT 35"
    ),
)
def od_flows(spark, sf):
    return rounded(rollups.od_flows(inputs.fhvhv_rides(spark, sf)), pct_of_all=6)


@register(
    "od_flows_borough",
    query(
        f"SELECT pickup_borough, dropoff_borough, count(*) AS trips, {r('count(*) / sum(count(*)) OVER () * 100', 6)} AS pct_of_all FROM fhvhv_trips GROUP BY 1, 2"
    ),
)
def od_flows_borough(spark, sf):
    trips = inputs.fhvhv_rides(spark, sf)
    return rounded(rollups.od_flows(trips, "pickup_borough", "dropoff_borough", None), pct_of_all=6)


@register(
    "busiest_zones",
    query("SELECT dropoff_zone, dropoff_borough, count(*) AS trips FROM fhvhv_trips GROUP BY 1, 2 ORDER BY trips DESC, dropoff_zone, dropoff_borough LIMIT 10"),
)
def busiest_zones(spark, sf):
    return rollups.busiest(inputs.fhvhv_rides(spark, sf), ["dropoff_zone", "dropoff_borough"], 10)


@register(
    "flow_nodes",
    query(
        "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS source_id, CAST(row_number() OVER (ORDER BY label) - 1 + count(*) OVER () AS INT) AS target_id "
        "FROM (SELECT pickup_zone AS label FROM yellow_trips UNION SELECT dropoff_zone FROM yellow_trips) WHERE label IS NOT NULL"
    ),
)
def flow_nodes(spark, sf):
    return rollups.flow_nodes(inputs.yellow_trips(spark, sf), "pickup_zone", "dropoff_zone")


@register(
    "semi_borough",
    query(
        "SELECT pz.Zone AS pickup_zone, dz.Zone AS dropoff_zone, count(*) AS trips FROM geo_study JOIN zones pz ON pz.LocationID = PULocationID JOIN zones dz ON dz.LocationID = DOLocationID "
        "WHERE pz.Borough = 'ASIA' AND dz.Borough = 'EUROPE' GROUP BY 1, 2"
    ),
)
def semi_borough(spark, sf):
    zones = inputs.zones(spark, sf)
    trips = enrich.keep_boroughs(inputs.geo_study_trips(spark, sf), zones, "ASIA", "EUROPE")
    return enrich.join_zones(trips, zones, "inner").groupBy("pickup_zone", "dropoff_zone").agg(F.count(F.lit(1)).alias("trips"))


@register(
    "union_services",
    query(f"SELECT source, PULocationID, count(*) AS trips, {r('sum(total_amount)', 2)} AS paid, CAST(sum(trip_time) AS BIGINT) AS seconds FROM all_trips GROUP BY 1, 2"),
)
def union_services(spark, sf):
    return inputs.all_trips(spark, sf).groupBy("source", "PULocationID").agg(
        F.count(F.lit(1)).alias("trips"),
        round_half_up(F.sum("total_amount"), 2).alias("paid"),
        F.sum("trip_time").alias("seconds"),
    )


# ---- weather ----------------------------------------------------------------

WEATHER_COLUMNS = ["temperature_2m", "precipitation", "rain", "wind_speed_10m"]


@register(
    "join_weather",
    query(
        "SELECT PULocationID, strftime(pickup_datetime, '%Y-%m-%d %H:%M:%S') AS pickup_datetime, "
        + ", ".join(f"{r(f'w.{c}', 6)} AS {c}" for c in WEATHER_COLUMNS)
        + ", trip_time FROM yellow_trips JOIN weather w ON w.id = PULocationID AND w.datetime = date_trunc('hour', pickup_datetime) WHERE w.rain IS NOT NULL"
    ),
)
def join_weather(spark, sf):
    joined = enrich.join_weather(inputs.yellow_trips(spark, sf), inputs.weather(spark, sf), WEATHER_COLUMNS)
    return joined.select(
        "PULocationID",
        F.date_format("pickup_datetime", "yyyy-MM-dd HH:mm:ss").alias("pickup_datetime"),
        *[round_half_up(F.col(c), 6).alias(c) for c in WEATHER_COLUMNS],
        "trip_time",
    )


HOURLY_RAIN = {
    "hourly": "SELECT date_trunc('hour', pickup_datetime) AS hour, PULocationID AS zone_id, count(*) AS trips FROM yellow_loaded WHERE PULocationID < 24 GROUP BY 1, 2",
    "rained": "SELECT h.*, rain, CASE WHEN rain > -1 THEN CASE WHEN rain <= 0 THEN 'no rain' WHEN rain <= 2.5 THEN 'light rain' WHEN rain <= 15 THEN 'moderate rain' ELSE 'heavy rain' END END AS rain_class "
              "FROM hourly h JOIN weather w ON w.id = h.zone_id AND w.datetime = h.hour WHERE rain IS NOT NULL",
}


def hourly_rain(spark, sf):
    trips = inputs.yellow_loaded(spark, sf).where(F.col("PULocationID") < 24)
    counts = enrich.hourly_counts(trips)
    return enrich.demand_weather(counts, inputs.weather(spark, sf)).withColumn("rain_class", fares.rain_class(F.col("rain")))


@register(
    "demand_weather",
    query(f"SELECT zone_id, strftime(hour, '%Y-%m-%d %H') AS hour, trips, {r('rain', 6)} AS rain FROM rained", HOURLY_RAIN),
)
def demand_weather(spark, sf):
    return hourly_rain(spark, sf).select(
        "zone_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "trips", round_half_up(F.col("rain"), 6).alias("rain")
    )


@register(
    "rain_class",
    query("SELECT rain_class, count(*) AS zone_hours FROM rained GROUP BY 1", HOURLY_RAIN),
)
def rain_class(spark, sf):
    return hourly_rain(spark, sf).groupBy("rain_class").agg(F.count(F.lit(1)).alias("zone_hours"))


@register(
    "rain_demand",
    query(
        f"SELECT 'total' AS level, rain_class, NULL::INT AS hour_of_day, NULL::BIGINT AS zone_id, CAST(sum(trips) AS DOUBLE) AS trips FROM rained GROUP BY 2 UNION ALL "
        f"SELECT 'hour_zone', rain_class, CAST(hour(hour) AS INT), zone_id, {r('avg(trips)', 6)} FROM rained GROUP BY 2, 3, 4 HAVING avg(trips) > 1 UNION ALL "
        f"SELECT 'hour', rain_class, CAST(hour(hour) AS INT), NULL, {r('avg(trips)', 6)} FROM rained GROUP BY 2, 3",
        HOURLY_RAIN,
    ),
)
def rain_demand(spark, sf):
    totals, by_zone, by_hour = rollups.rain_demand(hourly_rain(spark, sf), threshold=1.0)
    no_zone, no_hour = F.lit(None).cast("bigint").alias("zone_id"), F.lit(None).cast("int").alias("hour_of_day")
    mean = round_half_up(F.col("avg_trips"), 6).alias("trips")
    return (
        totals.select(F.lit("total").alias("level"), "rain_class", no_hour, no_zone, F.col("trips").cast("double"))
        .unionByName(by_zone.select(F.lit("hour_zone").alias("level"), "rain_class", "hour_of_day", "zone_id", mean))
        .unionByName(by_hour.select(F.lit("hour").alias("level"), "rain_class", "hour_of_day", no_zone, mean))
    )
