"""Cleaning rules at and around every limit; kept and rejected rows add up."""

from datetime import datetime, timedelta

import pytest

from tripflow import schemas
from tripflow.config import FHVHV, GREEN, YELLOW
from tripflow.operators import quality

START = datetime(2024, 5, 1, 12, 0)

YELLOW_ROW = dict(
    pickup_datetime=START, dropoff_datetime=START + timedelta(minutes=10), trip_distance=2.0, PULocationID=100,
    DOLocationID=200, tip_amount=2.0, total_amount=20.0, congestion_surcharge=2.5, airport_fee=None, cbd_congestion_fee=None,
)
FHVHV_ROW = dict(
    hvfhs_license_num="HV0003", request_datetime=START - timedelta(minutes=5), pickup_datetime=START,
    dropoff_datetime=START + timedelta(minutes=10), PULocationID=100, DOLocationID=200, trip_miles=2.0, trip_time=600,
    base_passenger_fare=20.0, tolls=None, sales_tax=None, congestion_surcharge=None, airport_fee=None, tips=None,
    driver_pay=10.0, shared_request_flag="y", shared_match_flag=None, cbd_congestion_fee=None,
)


def frame(spark, service, rows):
    ddl = {"yellow": schemas.YELLOW_RAW, "fhvhv": schemas.FHVHV_RAW, "green": schemas.GREEN_RAW}[service.name]
    for old, new in service.renames.items():
        ddl = ddl.replace(old, new)
    names = [part.split()[0] for part in ddl.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


YELLOW_CASES = [
    ({}, None),
    ({"PULocationID": 1, "airport_fee": 0.0}, None),
    ({"PULocationID": 0}, "zones"),
    ({"DOLocationID": 264}, "zones"),
    ({"DOLocationID": 263}, None),
    ({"PULocationID": None}, "zones"),
    ({"PULocationID": 132}, "airport_fee"),
    ({"DOLocationID": 138}, "airport_fee"),
    ({"pickup_datetime": datetime(2019, 12, 31, 23, 59)}, "dates"),
    ({"pickup_datetime": datetime(2020, 1, 1), "dropoff_datetime": datetime(2020, 1, 1, 0, 1)}, None),
    ({"dropoff_datetime": datetime(2026, 1, 1)}, "dates"),
    ({"dropoff_datetime": START}, "order"),
    ({"dropoff_datetime": None}, "dates"),
    ({"trip_distance": 0.1}, None),
    ({"trip_distance": 0.09}, "miles"),
    ({"trip_distance": 35.0}, None),
    ({"trip_distance": 35.01}, "miles"),
    ({"congestion_surcharge": -0.01}, "negative"),
    ({"congestion_surcharge": None}, "negative"),
    ({"tip_amount": -1.0}, "negative"),
    ({"tip_amount": None}, "negative"),
    ({"airport_fee": -1.0}, "negative"),
    ({"cbd_congestion_fee": -0.75}, "negative"),
    ({"total_amount": 1.0, "tip_amount": 0.0}, None),
    ({"total_amount": 0.99, "tip_amount": 0.0}, "fare"),
    ({"total_amount": 200.0}, None),
    ({"total_amount": 200.01}, "fare"),
    ({"tip_amount": 5.0}, None),
    ({"tip_amount": 5.01}, "tip_cap"),
]

FHVHV_CASES = [
    ({}, None),
    ({"request_datetime": None}, "request_time"),
    ({"PULocationID": 265}, "zones"),
    ({"PULocationID": 1}, "airport_fee"),
    ({"pickup_datetime": START - timedelta(minutes=5)}, "order"),
    ({"trip_miles": 60.0}, None),
    ({"trip_miles": 60.1}, "miles"),
    ({"trip_time": 299}, "seconds"),
    ({"trip_time": 300}, None),
    ({"trip_time": 7200}, None),
    ({"trip_time": 7201}, "seconds"),
    ({"driver_pay": -0.01}, "driver_pay"),
    ({"driver_pay": None}, "driver_pay"),
    ({"base_passenger_fare": 250.0}, None),
    ({"base_passenger_fare": 250.01}, "fare"),
    ({"tips": 10.0}, None),
    ({"tips": 10.01}, "tip_cap"),
    ({"tips": -0.01}, "tip_cap"),
]


@pytest.mark.parametrize("service, row, cases", [(YELLOW, YELLOW_ROW, YELLOW_CASES), (FHVHV, FHVHV_ROW, FHVHV_CASES)], ids=["yellow", "fhvhv"])
def test_each_limit(spark, service, row, cases):
    df = frame(spark, service, [{**row, **change} for change, _ in cases])
    rules = quality.rules_for(service)
    got = [r[0] for r in df.select(quality.first_failed_rule(rules)).collect()]
    assert got == [failed for _, failed in cases]
    kept, rejected = quality.passing(df, rules), quality.rejects(df, rules)
    assert kept.count() == sum(f is None for _, f in cases)
    assert kept.count() + rejected.count() == df.count()


def test_fills_and_flags(spark):
    yellow = quality.clean(frame(spark, YELLOW, [YELLOW_ROW]), YELLOW).first()
    assert (yellow["airport_fee"], yellow["cbd_congestion_fee"]) == (0.0, 0.0)
    ride = quality.clean(frame(spark, FHVHV, [FHVHV_ROW]), FHVHV).first()
    assert (ride["tips"], ride["tolls"], ride["shared_request_flag"], ride["shared_match_flag"]) == (0.0, 0.0, True, False)


def test_imputed_surcharge(spark):
    rows = [{**YELLOW_ROW, "congestion_surcharge": None, "PULocationID": 161}, {**YELLOW_ROW, "congestion_surcharge": None}]
    df = frame(spark, YELLOW, rows)
    assert quality.clean_street_taxi(df, YELLOW).count() == 0
    got = quality.clean_street_taxi(df, YELLOW, impute=True).select("congestion_surcharge").collect()
    assert sorted(r[0] for r in got) == [0.0, 2.5]


def test_optional_duration_limits(spark):
    service = YELLOW.with_limits(seconds=(300, 15800))
    rows = [{**YELLOW_ROW, "dropoff_datetime": START + timedelta(seconds=s)} for s in (299, 300, 15800, 15801)]
    df = frame(spark, YELLOW, rows)
    assert quality.clean_street_taxi(df, service).count() == 4
    assert quality.clean_street_taxi(df, service, duration_limits=True).count() == 2


def test_green_has_no_airport_rule(spark):
    row = {**YELLOW_ROW, "PULocationID": 132}
    assert quality.clean(frame(spark, GREEN, [row]), GREEN).count() == 1


def test_empty_input(spark):
    df = frame(spark, YELLOW, [])
    assert quality.clean(df, YELLOW).count() == 0
    assert {r["nulls"] for r in quality.profile_nulls(df).collect()} == {0}
    assert {r["pct"] for r in quality.profile_nulls(df).collect()} == {0.0}


def test_cameras_need_known_flags(spark):
    rows = [(40.6, -74.0, False, False), (40.6, -74.0, False, None), (40.6, -74.0, True, False), (41.0, -74.0, False, False), (None, -74.0, False, False)]
    df = spark.createDataFrame(rows, "Latitude double, Longitude double, Disabled boolean, Blocked boolean")
    assert quality.active_in_box(df, (40.49, 40.92), (-74.27, -73.70)).count() == 1
