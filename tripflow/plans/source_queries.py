"""Registered scans and sinks: derived inputs land as files and are read by the loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.functions.numeric import round_half_up
from tripflow.operators import rollups
from tripflow.plans import inputs
from tripflow.plans.check_sql import demand_sql, pick, query, r, ts_plus
from tripflow.plans.registry import register
from tripflow.session import shared_folder
from tripflow.sources import reference_data, sinks, trips

TS = "yyyy-MM-dd HH:mm:ss"


def ts_text(df, *columns):
    return df.withColumns({c: F.date_format(c, TS) for c in columns})


def sql_ts(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


STREET_COLUMNS = "PULocationID, DOLocationID, trip_distance, tip_amount, total_amount, congestion_surcharge, cbd_congestion_fee"


@register(
    "scan_trips_yellow",
    query(f"SELECT {sql_ts('pickup_datetime')}, {sql_ts('dropoff_datetime')}, {STREET_COLUMNS}, airport_fee, VendorID, tolls_amount FROM yellow_loaded"),
)
def scan_trips_yellow(spark, sf):
    df = trips.load_yellow(spark, inputs.raw_path(spark, sf, "yellow"))
    return ts_text(df, "pickup_datetime", "dropoff_datetime")


@register(
    "scan_trips_green",
    query(f"SELECT {sql_ts('pickup_datetime')}, {sql_ts('dropoff_datetime')}, {STREET_COLUMNS} FROM green_loaded"),
)
def scan_trips_green(spark, sf):
    df = trips.load_green(spark, inputs.raw_path(spark, sf, "green"))
    return ts_text(df, "pickup_datetime", "dropoff_datetime")


@register(
    "scan_trips_fhvhv",
    query(
        f"SELECT * REPLACE ({sql_ts('request_datetime')}, {sql_ts('pickup_datetime')}, {sql_ts('dropoff_datetime')}) FROM fhvhv_loaded"
    ),
)
def scan_trips_fhvhv(spark, sf):
    df = trips.load_fhvhv(spark, inputs.raw_path(spark, sf, "fhvhv"))
    return ts_text(df, "request_datetime", "pickup_datetime", "dropoff_datetime")


@register("scan_zones", query("SELECT LocationID, Borough, Zone, service_zone FROM zones"))
def scan_zones(spark, sf):
    path = shared_folder(spark, "zones")
    sinks.save_result(inputs.zones(spark, sf), path, "csv")
    return reference_data.load_zones(spark, path)


@register(
    "scan_weather",
    query(
        "SELECT id, strftime(datetime - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS datetime, CAST(year(datetime - INTERVAL 5 HOUR) AS INT) AS year, "
        "CAST(month(datetime - INTERVAL 5 HOUR) AS INT) AS month, CAST(day(datetime - INTERVAL 5 HOUR) AS INT) AS day, CAST(hour(datetime - INTERVAL 5 HOUR) AS INT) AS hour, "
        + ", ".join(
            f"{r(c, 6)} AS {c}"
            for c in ("temperature_2m", "apparent_temperature", "precipitation", "rain", "snowfall", "wind_speed_10m", "wind_gusts_10m", "relative_humidity_2m", "weather_code")
        )
        + " FROM weather"
    ),
)
def scan_weather(spark, sf):
    path = shared_folder(spark, "weather")
    inputs.weather(spark, sf).write.partitionBy("id").parquet(path)
    df = ts_text(reference_data.load_weather(spark, path), "datetime")
    values = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: round_half_up(F.col(c), 6) for c in values})


POI_TAGS_SQL = "CASE WHEN p_partkey % 6 = 0 THEN 'start_date=' || (2020 + p_partkey % 10) END"


def tagged_pois(spark, sf):
    """Places with open tags, some of them closed, planned or dated."""
    k = F.col("osm_id")
    value = (k % 10 + 2020).cast("string")
    tags = F.map_concat(
        F.create_map(F.lit("name"), F.col("name")),
        F.when(k % 6 == 0, F.create_map(F.lit("start_date"), value)).otherwise(F.create_map(F.lit("open"), F.lit("yes"))),
        F.when(k % 10 == 3, F.create_map(F.lit("disused:shop"), F.lit("yes"))).otherwise(F.create_map(F.lit("was"), F.lit("1"))),
        F.when(k % 14 == 5, F.create_map(F.lit("construction:shop"), F.lit("mall"))).otherwise(F.create_map(F.lit("operator"), F.concat(F.lit("op"), (k % 4).cast("string")))),
        F.when(k % 22 == 7, F.create_map(F.lit("opening_date"), F.lit("2026-05"))).otherwise(F.create_map(F.lit("opening_date"), F.lit("soon"))),
    )
    return inputs.pois(spark, sf).select(
        F.lit("place").alias("category"), "osm_id", F.lit("node").alias("type"), "lat", "lon", "name", tags.alias("tags"), "poi_type"
    )


def scanned_pois(spark, sf):
    path = inputs.landed_path(
        spark, sf, "pois", lambda p: tagged_pois(spark, sf).write.partitionBy("poi_type").parquet(p)
    )
    return reference_data.load_pois(spark, path)


@register(
    "scan_pois",
    query("SELECT osm_id, lat, lon, name, poi_type, split_part(poi_type, '_', 1) AS main_category, substr(poi_type, strpos(poi_type, '_') + 1) AS sub_category FROM pois"),
)
def scan_pois(spark, sf):
    return scanned_pois(spark, sf).select("osm_id", "lat", "lon", "name", "poi_type", "main_category", "sub_category")


@register(
    "poi_elements_flatten",
    "SELECT 'restaurant' AS category, p_partkey AS osm_id, CASE p_partkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS type, "
    "p_partkey / 100 AS lat, p_partkey / 50 AS lon, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name FROM part WHERE p_partkey % 3 <> 2 OR p_partkey % 4 <> 0",
)
def poi_elements_flatten(spark, sf):
    k = F.col("p_partkey")
    lat, lon = k / 100, k / 50
    elements = inputs.table(spark, sf, "part").select(
        inputs.pick(("node", "way", "relation"), k % 3).alias("type"),
        k.alias("id"),
        F.when(k % 3 == 0, lat).alias("lat"),
        F.when(k % 3 == 0, lon).alias("lon"),
        F.when((k % 3 == 1) | ((k % 3 == 2) & (k % 4 != 0)), F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"),
        F.when(k % 5 != 0, F.create_map(F.lit("name"), F.col("p_name"))).otherwise(F.create_map(F.lit("x"), F.lit("y"))).alias("tags"),
    )
    path = shared_folder(spark, "elements")
    elements.write.json(path)
    return reference_data.load_poi_elements(spark, path, "restaurant").drop("tags")


@register(
    "union_schema_drift",
    query(
        "SELECT VendorID, strftime(pickup_datetime, '%Y-%m-%d %H:%M:%S') AS tpep_pickup_datetime, total_amount, airport_fee, "
        "CASE WHEN pickup_datetime < TIMESTAMP '2024-01-15' THEN cbd_congestion_fee END AS cbd_congestion_fee FROM yellow_loaded"
    ),
)
def union_schema_drift(spark, sf):
    raw = spark.read.parquet(inputs.raw_path(spark, sf, "yellow"))
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    early = (
        raw.where(F.col("tpep_pickup_datetime") < cut)
        .withColumn("VendorID", F.col("VendorID").cast("int"))
        .withColumnRenamed("airport_fee", "Airport_fee")
    )
    late = raw.where(F.col("tpep_pickup_datetime") >= cut).drop("cbd_congestion_fee")
    types = {
        "VendorID": "bigint",
        "tpep_pickup_datetime": "timestamp_ntz",
        "total_amount": "double",
        "airport_fee": "double",
        "cbd_congestion_fee": "double",
    }
    return ts_text(trips.union_drifting([early, late], types), "tpep_pickup_datetime")


@register(
    "scan_month_range",
    query(
        "SELECT pickup_year, pickup_month, pickup_zone, count(*) AS trips FROM fhvhv_trips "
        "WHERE pickup_datetime >= TIMESTAMP '1997-11-15' AND pickup_datetime < TIMESTAMP '1998-02-10' GROUP BY 1, 2, 3"
    ),
)
def scan_month_range(spark, sf):
    kept = trips.range_filter(inputs.fhvhv_trips(spark, sf), "1997-11-15", "1998-02-10")
    return kept.groupBy("pickup_year", "pickup_month", "pickup_zone").agg(F.count(F.lit(1)).alias("trips"))


@register(
    "scan_clean_range",
    query(
        f"SELECT {sql_ts('pickup_datetime')}, PULocationID, DOLocationID FROM yellow_trips "
        "WHERE pickup_datetime >= TIMESTAMP '2024-01-05' AND pickup_datetime < TIMESTAMP '2024-01-20'"
    ),
)
def scan_clean_range(spark, sf):
    return ts_text(trips.clean_range(inputs.yellow_trips(spark, sf), "2024-01-05", "2024-01-20"), "pickup_datetime")


def scanned_sales(spark, sf):
    """Sales from files of two layouts: columns in another order, numbers with blanks and thousands separators."""

    def write(path):
        sales = inputs.sales(spark, sf)
        even = F.pmod(F.xxhash64("NEIGHBORHOOD"), F.lit(2)) == 0
        sinks.save_result(sales.where(even), path, "csv")
        other = sales.where(~even).withColumn("GROSS SQUARE FEET", F.concat(F.lit(" "), F.format_number("GROSS SQUARE FEET", 1)))
        other.select(F.lit("").alias("EASE-MENT"), *reversed(other.columns)).write.mode("append").option("header", True).csv(path)

    return reference_data.load_sales(spark, inputs.landed_path(spark, sf, "sales", write))


@register("scan_sales", query("SELECT * FROM sales"))
def scan_sales(spark, sf):
    return scanned_sales(spark, sf)


@register(
    "scan_events",
    query(
        'SELECT "Event Type" AS event_type, "Organization Name" AS organization, "Facility Name" AS facility, State AS state, '
        "strftime(create_time, '%m/%d/%Y %I:%M:%S %p') AS created, \"Responding Organization Id\" AS responder, Latitude AS latitude, Longitude AS longitude FROM incidents"
    ),
)
def scan_events(spark, sf):
    path = inputs.landed_path(
        spark, sf, "incidents", lambda p: sinks.save_result(inputs.incidents(spark, sf), p, "csv")
    )
    return reference_data.load_incident_history(spark, path).select(
        F.col("Event Type").alias("event_type"),
        F.col("Organization Name").alias("organization"),
        F.col("Facility Name").alias("facility"),
        F.col("State").alias("state"),
        F.col("Create Time").alias("created"),
        F.col("Responding Organization Id").alias("responder"),
        F.col("Latitude").alias("latitude"),
        F.col("Longitude").alias("longitude"),
    )


def scanned_notices(spark, sf):
    path = inputs.landed_path(spark, sf, "notices", lambda p: inputs.notices(spark, sf).write.json(p))
    return reference_data.load_event_feed(spark, path)


@register(
    "scan_feed_json",
    query(
        "SELECT ID, EventSubType, RegionName, RoadwayName, Latitude, Longitude, strftime(StartDate, '%d/%m/%Y %H:%M:%S') AS first_start, "
        "CAST(length(Description) AS INT) AS description_length, md5(Description) AS description_md5 FROM notices"
    ),
)
def scan_feed_json(spark, sf):
    return scanned_notices(spark, sf).select(
        "ID",
        "EventSubType",
        "RegionName",
        "RoadwayName",
        "Latitude",
        "Longitude",
        F.get("Schedule", F.lit(0))["Start"].alias("first_start"),
        F.length("Description").alias("description_length"),
        F.md5("Description").alias("description_md5"),
    )


@register("scan_cameras", query("SELECT * EXCLUDE (s_suppkey) FROM cameras"))
def scan_cameras(spark, sf):
    path = inputs.landed_path(spark, sf, "camera_feed", lambda p: inputs.cameras(spark, sf).write.json(p))
    return reference_data.load_camera_feed(spark, path)


# ---- sinks ------------------------------------------------------------------

@register(
    "sink_partitioned_roundtrip",
    query(f"SELECT pickup_year, pickup_month, pickup_borough, count(*) AS trips, {r('sum(total_amount)', 2)} AS paid FROM fhvhv_trips GROUP BY 1, 2, 3"),
)
def sink_partitioned_roundtrip(spark, sf):
    path = shared_folder(spark, "trips")
    columns = ["pickup_year", "pickup_month", "pickup_borough", "total_amount"]
    sinks.save_trips(inputs.fhvhv_trips(spark, sf), path, columns)
    return (
        spark.read.parquet(path)
        .groupBy("pickup_year", "pickup_month", "pickup_borough")
        .agg(F.count(F.lit(1)).alias("trips"), round_half_up(F.sum("total_amount"), 2).alias("paid"))
    )


@register(
    "sink_result_table",
    query(f"SELECT pickup_year, count(*) AS total_trips, {r('avg(total_amount)', 2)} AS avg_fare, {r('avg(trip_miles)', 2)} AS avg_miles, "
          f"{r('avg(trip_time) / 60', 2)} AS avg_duration_min, {r('avg(company_fees)', 2)} AS avg_company_fees FROM fhvhv_trips GROUP BY 1"),
)
def sink_result_table(spark, sf):
    path = shared_folder(spark, "yearly")
    sinks.result_table(spark, path, lambda: rollups.yearly_trend(inputs.fhvhv_rides(spark, sf), inputs.FHVHV_CITY))
    return sinks.result_table(spark, path, lambda: None)
