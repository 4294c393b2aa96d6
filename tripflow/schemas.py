"""Fixed read schemas. A narrow schema is also the column pruning of the scan."""

from __future__ import annotations

# Column names and types of the public input files (DDL).
YELLOW_RAW = """
    VendorID bigint, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz,
    trip_distance double, PULocationID bigint, DOLocationID bigint,
    tip_amount double, tolls_amount double, total_amount double, congestion_surcharge double,
    airport_fee double, cbd_congestion_fee double
"""

GREEN_RAW = """
    lpep_pickup_datetime timestamp_ntz, lpep_dropoff_datetime timestamp_ntz,
    trip_distance double, PULocationID bigint, DOLocationID bigint,
    tip_amount double, total_amount double, congestion_surcharge double,
    cbd_congestion_fee double
"""

FHVHV_RAW = """
    hvfhs_license_num string, request_datetime timestamp_ntz,
    pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz,
    PULocationID bigint, DOLocationID bigint, trip_miles double, trip_time bigint,
    base_passenger_fare double, tolls double, sales_tax double,
    congestion_surcharge double, airport_fee double, tips double, driver_pay double,
    shared_request_flag string, shared_match_flag string, cbd_congestion_fee double
"""

WEATHER_VALUES = (
    "temperature_2m", "apparent_temperature", "precipitation", "rain", "snowfall",
    "wind_speed_10m", "wind_gusts_10m", "relative_humidity_2m", "weather_code",
)
WEATHER_RAW = "datetime timestamp_ntz, " + ", ".join(f"{c} double" for c in WEATHER_VALUES)

POI_RAW = """
    category string, osm_id bigint, type string, lat double, lon double,
    name string, tags map<string,string>
"""

POI_ELEMENT = """
    type string, id bigint, lat double, lon double,
    center struct<lat: double, lon: double>, tags map<string,string>
"""

SALES = """
    BOROUGH int, NEIGHBORHOOD string, ADDRESS string, `ZIP CODE` string,
    `GROSS SQUARE FEET` double, `SALE PRICE` double, `SALE DATE` string,
    taxi_zone_id int
"""

EVENT_FEED = """
    ID string, EventType string, EventSubType string, RegionName string,
    RoadwayName string, Latitude double, Longitude double, CountyName string,
    Schedule array<struct<Start: string, End: string>>, Description string
"""

CAMERA_FEED = """
    ID string, Url string, VideoUrl string, RoadwayName string,
    DirectionOfTravel string, Latitude double, Longitude double,
    Disabled boolean, Blocked boolean
"""

INCIDENT_HISTORY = """
    `Event Type` string, `Organization Name` string, `Facility Name` string,
    Direction string, City string, County string, State string,
    `Create Time` string, `Close Time` string, `Event Description` string,
    `Responding Organization Id` string, Latitude double, Longitude double,
    Georeference string
"""

ZONE_GEOMETRY = "id int, zone string, borough string, geometry string"
