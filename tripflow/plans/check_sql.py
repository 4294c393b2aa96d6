"""The derived inputs as SQL text, and helpers to write check queries."""

from __future__ import annotations

import re

from tripflow.functions.text import VENUE_CAPACITY
from tripflow.plans.inputs import EVENT_SUBTYPES, INCIDENT_TYPES, POI_TYPES, SES_TYPES


def r(expr: str, digits: int) -> str:
    """Half-up rounding as in functions.numeric.round_half_up."""
    scale = f"1e{digits}"
    return f"(sign({expr}) * floor(abs({expr}) * {scale} + 0.500001) / {scale})"


def pick(values, index: str) -> str:
    cases = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values)
    )
    return f"(CASE {index} {cases} END)"


def tip_cat(x: str) -> str:
    return f"(CASE WHEN {x}=0 THEN 0 WHEN {x}<2 THEN 1 WHEN {x}<3 THEN 2 WHEN {x}<5 THEN 3 ELSE 4 END)"


CALENDAR = """
    CAST(year(pickup_datetime) AS INT) AS pickup_year,
    CAST(month(pickup_datetime) AS INT) AS pickup_month,
    CAST(day(pickup_datetime) AS INT) AS pickup_day,
    CAST(hour(pickup_datetime) AS INT) AS pickup_hour,
    CAST(dayofweek(pickup_datetime) + 1 AS INT) AS pickup_day_of_week,
    dayname(pickup_datetime) AS pickup_day_name,
    dayofweek(pickup_datetime) IN (0, 6) AS pickup_is_weekend,
    CASE WHEN hour(pickup_datetime) < 6 THEN 'late_night' WHEN hour(pickup_datetime) < 10 THEN 'morning_rush'
         WHEN hour(pickup_datetime) < 16 THEN 'midday' WHEN hour(pickup_datetime) < 20 THEN 'evening_rush'
         ELSE 'night' END AS time_of_day
"""

ZONED = """
    pz.Borough AS pickup_borough, pz.Zone AS pickup_zone, pz.service_zone AS pickup_service_zone,
    dz.Borough AS dropoff_borough, dz.Zone AS dropoff_zone, dz.service_zone AS dropoff_service_zone
"""

ZONE_JOINS = "LEFT JOIN zones pz ON pz.LocationID = PULocationID LEFT JOIN zones dz ON dz.LocationID = DOLocationID"

AIRPORT = "(PULocationID IN (1,2,3) OR DOLocationID IN (1,2,3))"

YELLOW_RULES = {
    "zones": "PULocationID BETWEEN 1 AND 23 AND DOLocationID BETWEEN 1 AND 23",
    "airport_fee": f"NOT ({AIRPORT} AND airport_fee IS NULL)",
    "dates": "pickup_datetime >= TIMESTAMP '2024-01-01' AND pickup_datetime < TIMESTAMP '2024-01-30' "
             "AND dropoff_datetime >= TIMESTAMP '2024-01-01' AND dropoff_datetime < TIMESTAMP '2024-01-30'",
    "order": "dropoff_datetime > pickup_datetime",
    "miles": "trip_distance BETWEEN 0.1 AND 35",
    "negative": "tip_amount >= 0 AND total_amount >= 0 AND congestion_surcharge >= 0 "
                "AND coalesce(airport_fee, 0) >= 0 AND coalesce(cbd_congestion_fee, 0) >= 0",
    "fare": "total_amount BETWEEN 1 AND 200",
    "tip_cap": "tip_amount <= total_amount * 0.25::DOUBLE",
}
GREEN_RULES = {
    **{k: v for k, v in YELLOW_RULES.items() if k != "airport_fee"},
    "dates": "pickup_datetime >= TIMESTAMP '1995-01-01' AND pickup_datetime < TIMESTAMP '2001-07-01' "
             "AND dropoff_datetime >= TIMESTAMP '1995-01-01' AND dropoff_datetime < TIMESTAMP '2001-07-01'",
    "negative": "tip_amount >= 0 AND total_amount >= 0 AND congestion_surcharge >= 0 "
                "AND coalesce(cbd_congestion_fee, 0) >= 0",
}
FHVHV_RULES = {
    "request_time": "request_datetime IS NOT NULL",
    "zones": YELLOW_RULES["zones"],
    "airport_fee": YELLOW_RULES["airport_fee"],
    "dates": " AND ".join(
        f"{c} >= TIMESTAMP '1995-01-01' AND {c} < TIMESTAMP '2001-07-01'"
        for c in ("request_datetime", "pickup_datetime", "dropoff_datetime")
    ),
    "order": "dropoff_datetime > pickup_datetime AND pickup_datetime > request_datetime",
    "miles": "trip_miles BETWEEN 0.1 AND 60",
    "seconds": "trip_time BETWEEN 300 AND 7200",
    "driver_pay": "driver_pay >= 0",
    "fare": "base_passenger_fare BETWEEN 1 AND 250",
    "tip_cap": "coalesce(tips, 0) >= 0 AND coalesce(tips, 0) <= base_passenger_fare * 0.5::DOUBLE",
}


def where_all(rules: dict[str, str]) -> str:
    return " AND ".join(f"({v})" for v in rules.values())


def first_failed(rules: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce({v}, false) THEN '{k}'" for k, v in rules.items()) + " END"


def ts_plus(ts: str, seconds: str) -> str:
    return f"({ts} + to_seconds(CAST({seconds} AS BIGINT)))"


SUBTYPES = pick(EVENT_SUBTYPES, "doc_id % 9")
VENUE_PICK = pick(tuple(VENUE_CAPACITY), "(doc_id // 5) % 11")
INITCAP_VENUE = pick(tuple(v.title() for v in VENUE_CAPACITY), "(doc_id // 5) % 11")

CTES = {
    "zones": f"""
        SELECT CAST(n_nationkey + 1 AS INT) AS LocationID, r_name AS Borough,
               n_name || CASE WHEN n_nationkey < 3 THEN ' Airport' ELSE '' END AS Zone,
               {pick(("Yellow Zone", "Boro Zone", "Airports"), "n_nationkey % 3")} AS service_zone
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "yellow_loaded": f"""
        SELECT event_id % 3 + 1 AS VendorID, ts AS pickup_datetime,
               {ts_plus("ts", "event_id * 37 % 6000 - 60")} AS dropoff_datetime,
               value / 10 AS trip_distance, user_id % 25 + 1 AS PULocationID, event_id * 7 % 25 + 1 AS DOLocationID,
               value * (event_id % 30) / 100 AS tip_amount, value AS total_amount,
               CAST(CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 97 = 0 THEN -2.5 ELSE 2.5 END AS DOUBLE) AS congestion_surcharge,
               CAST(CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 101 = 0 THEN -1.75 ELSE event_id % 3 * 0.5 END AS DOUBLE) AS airport_fee,
               CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE 0.75 END AS DOUBLE) AS cbd_congestion_fee,
               CAST(CASE WHEN event_id % 50 = 0 THEN -1.0 WHEN event_id % 9 = 0 THEN 6.55 ELSE 0.0 END AS DOUBLE) AS tolls_amount
        FROM events""",
    "green_loaded": f"""
        SELECT {ts_plus("o_orderdate", "o_orderkey % 86400")} AS pickup_datetime,
               {ts_plus("o_orderdate", "o_orderkey % 86400 + o_orderkey * 31 % 7200 - 30")} AS dropoff_datetime,
               o_orderkey % 400 / 10 AS trip_distance, o_custkey % 25 + 1 AS PULocationID, o_orderkey * 3 % 25 + 1 AS DOLocationID,
               o_totalprice / 2000 * (o_orderkey % 35) / 100 AS tip_amount, o_totalprice / 2000 AS total_amount,
               CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 2.75 END AS DOUBLE) AS congestion_surcharge,
               CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0.75 END AS DOUBLE) AS cbd_congestion_fee
        FROM orders""",
    "fhvhv_loaded": f"""
        SELECT 'HV000' || (l_suppkey % 5 + 2) AS hvfhs_license_num,
               CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE {ts_plus("o_orderdate", "l_orderkey % 1440 * 60")} END AS request_datetime,
               {ts_plus("o_orderdate", "l_orderkey % 1440 * 60 + 60 + l_partkey % 900")} AS pickup_datetime,
               {ts_plus("o_orderdate", "l_orderkey % 1440 * 60 + 60 + l_partkey % 900 + l_partkey * 13 % 7400 + 200")} AS dropoff_datetime,
               o_custkey % 25 + 1 AS PULocationID, l_suppkey % 25 + 1 AS DOLocationID, l_quantity AS trip_miles,
               l_partkey * 13 % 7400 + 200 AS trip_time, l_extendedprice / 400 AS base_passenger_fare,
               CAST(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber % 3 * 1.5 END AS DOUBLE) AS tolls,
               l_extendedprice / 400 * l_tax AS sales_tax, CAST(l_linenumber % 2 * 2.75 AS DOUBLE) AS congestion_surcharge,
               CAST(CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_orderkey % 2 * 2.5 END AS DOUBLE) AS airport_fee,
               CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice / 400 * l_discount * 6 END AS tips,
               l_extendedprice / 400 * 0.75::DOUBLE + CASE WHEN l_orderkey % 37 = 0 THEN -400.0 WHEN l_orderkey % 41 = 0 THEN 400.0 ELSE 0.0 END::DOUBLE AS driver_pay,
               CASE WHEN l_returnflag = 'A' THEN 'Y' WHEN l_returnflag = 'N' THEN 'N' WHEN l_linenumber = 1 THEN NULL ELSE 'y' END AS shared_request_flag,
               CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS shared_match_flag,
               CAST(CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 1.5 END AS DOUBLE) AS cbd_congestion_fee
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "yellow_clean": f"""
        SELECT * REPLACE (coalesce(airport_fee, 0) AS airport_fee, coalesce(cbd_congestion_fee, 0) AS cbd_congestion_fee)
        FROM yellow_loaded WHERE {where_all(YELLOW_RULES)}""",
    "green_clean": f"""
        SELECT * REPLACE (coalesce(cbd_congestion_fee, 0) AS cbd_congestion_fee)
        FROM green_loaded WHERE {where_all(GREEN_RULES)}""",
    "fhvhv_clean": f"""
        SELECT * REPLACE (coalesce(airport_fee, 0) AS airport_fee, coalesce(cbd_congestion_fee, 0) AS cbd_congestion_fee,
               coalesce(tips, 0) AS tips, coalesce(tolls, 0) AS tolls, coalesce(sales_tax, 0) AS sales_tax,
               coalesce(congestion_surcharge, 0) AS congestion_surcharge,
               coalesce(upper(shared_request_flag) = 'Y', false) AS shared_request_flag,
               coalesce(upper(shared_match_flag) = 'Y', false) AS shared_match_flag)
        FROM fhvhv_loaded WHERE {where_all(FHVHV_RULES)}""",
    "yellow_trips": f"""
        SELECT c.*, {ZONED}, CAST(floor(epoch(dropoff_datetime)) - floor(epoch(pickup_datetime)) AS BIGINT) AS trip_time,
               {tip_cat("tip_amount")} AS tip_category, {CALENDAR}
        FROM yellow_clean c {ZONE_JOINS}""",
    "green_trips": f"""
        SELECT c.*, {ZONED}, CAST(floor(epoch(dropoff_datetime)) - floor(epoch(pickup_datetime)) AS BIGINT) AS trip_time,
               {tip_cat("tip_amount")} AS tip_category, {CALENDAR}
        FROM green_clean c {ZONE_JOINS}""",
    "fhvhv_totals": f"""
        SELECT *, {r("base_passenger_fare + tolls + sales_tax + congestion_surcharge + airport_fee + tips + cbd_congestion_fee", 2)} AS total_amount
        FROM fhvhv_clean""",
    "fhvhv_trips": f"""
        SELECT c.*, {ZONED}, total_amount - driver_pay AS company_fees,
               CASE hvfhs_license_num WHEN 'HV0002' THEN 'Juno' WHEN 'HV0003' THEN 'Uber' WHEN 'HV0004' THEN 'Via'
                    WHEN 'HV0005' THEN 'Lyft' ELSE hvfhs_license_num END AS company,
               CAST(epoch(pickup_datetime) - epoch(request_datetime) AS BIGINT) AS wait_time,
               {tip_cat("tips")} AS tip_category, {CALENDAR}
        FROM fhvhv_totals c {ZONE_JOINS} WHERE total_amount > driver_pay""",
    "all_trips": """
        SELECT CAST(PULocationID AS INT) AS PULocationID, pickup_datetime, trip_distance AS trip_miles, trip_time,
               total_amount, tip_amount AS tips, pickup_borough, pickup_zone, 'yellow' AS source FROM yellow_trips
        UNION ALL
        SELECT CAST(PULocationID AS INT), pickup_datetime, trip_miles, trip_time,
               total_amount, tips, pickup_borough, pickup_zone, 'fhvhv' FROM fhvhv_trips""",
    "geo_study": """
        SELECT *, (floor(epoch(dropoff_datetime)) - floor(epoch(pickup_datetime))) / 60 AS duration_minutes
        FROM yellow_loaded
        WHERE trip_distance > 0 AND trip_distance <= 50 AND total_amount BETWEEN 2.5 AND 500
          AND (floor(epoch(dropoff_datetime)) - floor(epoch(pickup_datetime))) / 60 BETWEEN 1 AND 180
          AND year(pickup_datetime) BETWEEN 2022 AND 2025 AND year(dropoff_datetime) BETWEEN 2022 AND 2025
          AND tip_amount >= 0 AND tolls_amount >= 0
          AND PULocationID NOT IN (24, 25) AND DOLocationID NOT IN (24, 25)""",
    "weather": """
        SELECT date_trunc('hour', ts) AS datetime, CAST(user_id % 25 + 1 AS INT) AS id,
               min(value) / 4 - 5 AS temperature_2m, min(value) / 4 - 7 AS apparent_temperature,
               CASE WHEN max(event_id) % 2 = 0 THEN 0 ELSE max(value) / 20 END AS precipitation,
               CASE WHEN max(event_id) % 19 = 0 THEN NULL WHEN max(event_id) % 2 = 0 THEN 0 ELSE max(value) / 20 END AS rain,
               CAST(CASE WHEN max(event_id) % 7 = 0 THEN 1.5 ELSE 0.0 END AS DOUBLE) AS snowfall,
               max(value) / 15 AS wind_speed_10m, max(value) / 10 AS wind_gusts_10m,
               CAST(count(*) % 100 AS DOUBLE) AS relative_humidity_2m, CAST(max(event_id) % 4 AS DOUBLE) AS weather_code
        FROM events GROUP BY 1, 2""",
    "pois": f"""
        SELECT p_partkey AS osm_id, {pick(POI_TYPES, "p_partkey % 16")} AS poi_type,
               p_partkey * 7919 % 10500 / 1000 AS lon, p_partkey * 4729 % 10300 / 1000 AS lat, p_name AS name FROM part""",
    "ses_pois": f"""
        SELECT c_custkey AS osm_id, {pick(SES_TYPES, "c_custkey % 7")} AS poi_type, CAST(c_custkey * 11 % 25 + 1 AS INT) AS id FROM customer""",
    "zone_areas": """
        SELECT LocationID AS id, Zone AS zone, Borough AS borough,
               CASE WHEN LocationID = 4 THEN 0 ELSE CAST(LocationID * 0.25 + 1 AS DOUBLE) END AS area_miles2 FROM zones""",
    "poi_zones": """
        SELECT *, CASE WHEN lon < 10 AND lat < 10 THEN CAST(floor(lat / 2) * 5 + floor(lon / 2) + 1 AS INT) END AS id FROM pois""",
    "sales": """
        SELECT CAST(p_partkey % 5 + 1 AS INT) AS BOROUGH, p_brand AS NEIGHBORHOOD,
               CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_name || ' street, APT ' || p_size END AS ADDRESS,
               (p_partkey % 200 + 10001) || '.0' AS "ZIP CODE",
               CAST(CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE p_size * 100.0 END AS DOUBLE) AS "GROSS SQUARE FEET",
               CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE p_retailprice * 1000 END AS "SALE PRICE",
               CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE '2025-03-01' END AS "SALE DATE",
               CAST(p_partkey * 3 % 25 + 1 AS INT) AS taxi_zone_id FROM part""",
    "incidents": f"""
        SELECT event_id, ts AS create_time, CASE WHEN event_id % 71 = 0 THEN NULL ELSE {pick(INCIDENT_TYPES, "(event_id + user_id) % 12")} END AS "Event Type",
               'Org ' || user_id % 20 AS "Organization Name", 'Facility ' || user_id % 9 AS "Facility Name",
               {pick(("NY", "NJ", "CT", "PA", None), "event_id % 5")} AS State,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE {ts_plus("ts", "event_id * 37 % 6000 * (event_id % 7) - 300")} END AS close_time,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'R' || user_id % 17 END AS "Responding Organization Id",
               event_id * 4729 % 10300 / 1000 AS Latitude, event_id * 7919 % 10500 / 1000 AS Longitude
        FROM events""",
    "notices": f"""
        SELECT doc_id, CAST(doc_id AS VARCHAR) AS ID, {SUBTYPES} AS EventSubType,
               CASE WHEN doc_id % 4 = 3 THEN 'Long Island' ELSE 'New York City Area' END AS RegionName,
               CASE WHEN doc_id % 5 = 0 THEN {INITCAP_VENUE} ELSE 'W ' || doc_id % 50 || ' ST' END AS RoadwayName,
               doc_id * 4729 % 10300 / 1000 AS Latitude, doc_id * 7919 % 10500 / 1000 AS Longitude,
               'County ' || doc_id % 5 AS CountyName,
               CASE WHEN doc_id % 41 <> 0 THEN TIMESTAMP '2024-01-01 18:00:00' + to_days(CAST((doc_id // 5) % 60 AS INT)) END AS StartDate,
               CASE WHEN doc_id % 41 <> 0 THEN TIMESTAMP '2024-01-01 23:30:00' + to_days(CAST((doc_id // 5) % 60 + doc_id % 3 AS INT)) END AS EndDate,
               CASE WHEN doc_id % 7 = 0 THEN intro || text || '... Closures are at the discretion of the NYPD.'
                    WHEN doc_id % 7 = 1 THEN intro || 'Gala ' || doc_id % 12 || ', Sunday from noon. ' || text
                    WHEN doc_id % 7 = 2 THEN 'No bracket on monday ' || text
                    WHEN doc_id % 7 = 3 THEN intro || 'Parade ' || doc_id % 6 || '. Closures are at the discretion of the NYPD. ' || text
                    ELSE intro || text END AS Description
        FROM (SELECT *, 'Event at ' || CASE WHEN doc_id % 3 = 2 THEN 'somewhere' ELSE {VENUE_PICK} END || ' (New York) ' AS intro FROM documents)""",
    "cameras": f"""
        SELECT s_suppkey, 'CAM-' || s_suppkey AS ID, CASE WHEN s_suppkey % 13 <> 0 THEN 'https://cams.example.com/map/' || s_suppkey END AS Url,
               CASE WHEN s_suppkey % 4 <> 0 THEN 'https://video.example.com/' || s_suppkey || '.m3u8' END AS VideoUrl,
               CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'Road ' || s_suppkey % 40 END AS RoadwayName,
               {pick(("North", "South", "East", "West"), "s_suppkey % 4")} AS DirectionOfTravel,
               s_suppkey * 4729 % 10300 / 1000 AS Latitude, s_suppkey * 7919 % 10500 / 1000 AS Longitude,
               s_suppkey % 10 = 0 AS Disabled, CASE WHEN s_suppkey % 8 = 3 THEN NULL ELSE s_suppkey % 15 = 0 END AS Blocked
        FROM supplier""",
    "tip_scores": """
        SELECT event_id, CAST(user_id % 23 + 1 AS INT) AS zone_id, CAST(hour(ts) AS INT) AS pickup_hour,
               CAST(event_id * 5 % 5 + event_id % 3 AS INT) AS tip_category,
               w0 / w AS prob_class_0, w1 / w AS prob_class_1, w2 / w AS prob_class_2, w3 / w AS prob_class_3, w4 / w AS prob_class_4
        FROM (SELECT *, w0 + w1 + w2 + w3 + w4 AS w FROM (SELECT *, event_id * 3 % 97 + 1 AS w0, event_id * 7 % 97 + 1 AS w1,
              event_id * 11 % 97 + 1 AS w2, event_id * 13 % 97 + 1 AS w3, event_id * 17 % 97 + 1 AS w4 FROM events))""",
    "zone_demand": "",  # filled below
}


def _metrics(suffix: str, filt: str) -> str:
    f = f" FILTER (WHERE {filt})" if filt else ""
    return ", ".join(
        [
            f"{r(f'avg(total_amount){f}', 2)} AS avg_fare{suffix}",
            f"{r(f'avg(tips){f}', 2)} AS avg_tip{suffix}",
            f"{r(f'avg(tip_pct){f}', 2)} AS avg_tip_pct{suffix}",
            f"{r(f'avg(trip_miles){f}', 2)} AS avg_trip_miles{suffix}",
            f"CAST({r(f'avg(trip_time){f}', 0)} AS BIGINT) AS avg_trip_time_secs{suffix}",
        ]
    )


def demand_sql(source: str, per_source: bool, extra: str = "") -> str:
    """Zone demand over a CTE with the common trip columns."""
    sources = ""
    if per_source:
        for name in ("yellow", "fhvhv"):
            sources += f", {_metrics('_' + name, f'source = {chr(39)}{name}{chr(39)}')}"
            sources += f", count(*) FILTER (WHERE source = '{name}') AS trips_{name}"
        sources += f", {r('count(*) FILTER (WHERE source = ' + chr(39) + 'yellow' + chr(39) + ') / count(*) * 100', 1)} AS yellow_share_pct"
    bands = "".join(
        f", {r(f'count(*) FILTER (WHERE hour(pickup_datetime) BETWEEN {a} AND {b}) / any_value(n_days)', 1)} AS pickups_{name}"
        for name, (a, b) in {"morning": (6, 11), "afternoon": (12, 17), "evening": (18, 23), "night": (0, 5)}.items()
    )
    return f"""
        SELECT PULocationID, pickup_borough, pickup_zone, count(*) AS total_trips,
               {r("count(*) / any_value(n_days)", 1)} AS avg_daily_pickups,
               {r("quantile_disc(total_amount, 0.5)", 2)} AS median_fare,
               {_metrics("", "")}{sources}{bands}{extra}
        FROM (SELECT *, CASE WHEN total_amount > 0 THEN tips / total_amount * 100 ELSE 0 END AS tip_pct,
                     date_diff('day', min(CAST(pickup_datetime AS DATE)) OVER (), max(CAST(pickup_datetime AS DATE)) OVER ()) + 1 AS n_days
              FROM {source})
        GROUP BY 1, 2, 3"""


CTES["zone_demand"] = demand_sql("all_trips", True)


def query(body: str, extra: dict[str, str] | None = None) -> str:
    """The body with the derived inputs it names in front, in order of use."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def need(text: str, itself: str | None = None) -> None:
        words = set(re.findall(r"\b[a-z_0-9]+\b", text))
        for name, definition in known.items():
            if name in words and name != itself and name not in order:
                need(definition, name)
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + body
