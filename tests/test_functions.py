"""Column functions on hand-written edge rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tripflow.config import YELLOW
from tripflow.functions import calendar, fares, numeric, text


def column(spark, values, kind, build):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_round_half_up(spark):
    values = [1.005, 2.675, 0.125, -1.005, 1.00499999999, 3.0, None, 1.0049]
    got = column(spark, values, "double", lambda c: numeric.round_half_up(c, 2))
    assert got == [1.01, 2.68, 0.13, -1.01, 1.01, 3.0, None, 1.0]


def test_bands_and_times_of_day(spark):
    hours = list(range(24))
    bands = column(spark, hours, "int", calendar.time_band)
    times = column(spark, hours, "int", calendar.time_of_day)
    assert bands == ["night"] * 6 + ["morning"] * 6 + ["afternoon"] * 6 + ["evening"] * 6
    assert times == ["late_night"] * 6 + ["morning_rush"] * 4 + ["midday"] * 6 + ["evening_rush"] * 4 + ["night"] * 4


def test_calendar_columns(spark):
    rows = [(datetime(2024, 12, 31, 23, 59, 59),), (datetime(2024, 1, 6, 0, 0),), (datetime(2024, 1, 7, 5, 0),)]
    df = spark.createDataFrame(rows, "pickup_datetime timestamp_ntz")
    got = [tuple(r) for r in calendar.add_pickup_calendar(df).drop("pickup_datetime").collect()]
    assert got[0] == (2024, 12, 31, 23, 3, "Tuesday", False, "night")
    assert got[1][4:7] == (7, "Saturday", True)
    assert got[2][4:8] == (1, "Sunday", True, "late_night")


def test_hour_floor_keeps_the_wall_clock(spark):
    clock_change = [datetime(2024, 3, 10, 2, 30), datetime(2024, 11, 3, 1, 59, 59, 999999)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = column(spark, clock_change, "timestamp_ntz", calendar.hour_floor)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [datetime(2024, 3, 10, 2), datetime(2024, 11, 3, 1)]


def test_utc_to_local(spark):
    utc = [datetime(2024, 1, 1, 3, 0), datetime(2024, 7, 1, 3, 0)]
    got = column(spark, utc, "timestamp_ntz", lambda c: calendar.utc_to_local(c, "America/New_York"))
    assert got == [datetime(2023, 12, 31, 22, 0), datetime(2024, 6, 30, 23, 0)]


def test_relative_day(spark):
    today = F.lit("2024-01-05").cast("date")  # a Friday
    words = ["today", "Tomorrow", "yesterday", "next friday", "next saturday", "2024-02-29", "june 3rd 2026", "soon", "next week"]
    got = column(spark, words, "string", lambda c: calendar.relative_day(c, today))
    assert got == [
        date(2024, 1, 5), date(2024, 1, 6), date(2024, 1, 4), date(2024, 1, 12), date(2024, 1, 6),
        date(2024, 2, 29), date(2026, 6, 3), None, None,
    ]


def test_tip_categories(spark):
    tips = [0.0, 0.01, 1.99, 2.0, 2.99, 3.0, 4.99, 5.0, None]
    assert column(spark, tips, "double", fares.tip_category) == [0, 1, 1, 2, 2, 3, 3, 4, None]
    assert column(spark, [0, 4], "int", fares.tip_label) == ["$0", "$5+"]


def test_tip_ranges(spark):
    pct = [0.0, 5.0, 9.99, 10.0, 15.0, 20.0, 25.0, 30.0, 50.0]
    assert column(spark, pct, "double", lambda c: fares.tip_pct_range(c, "yellow")) == [
        "0-5%", "5-10%", "5-10%", "10-15%", "15-20%", "20-25%", "20-25%", "20-25%", "20-25%",
    ]
    assert column(spark, pct, "double", lambda c: fares.tip_pct_range(c, "fhvhv"))[-3:] == ["25-30%", "30-50%", "30-50%"]


def test_rain_classes_are_right_closed(spark):
    rain = [-1.0, -0.5, 0.0, 0.01, 2.5, 2.51, 15.0, 15.01, None]
    assert column(spark, rain, "double", fares.rain_class) == [
        None, "no rain", "no rain", "light rain", "light rain", "moderate rain", "moderate rain", "heavy rain", None,
    ]


def test_trip_length(spark):
    assert column(spark, [1.49, 1.5, 4.99, 5.0], "double", lambda c: fares.trip_length_class(c, YELLOW.length_cuts)) == [
        "short", "medium", "medium", "long",
    ]


def test_flags_and_companies(spark):
    assert column(spark, ["Y", "y", "N", "", None], "string", fares.yes_flag) == [True, True, False, False, False]
    assert column(spark, ["HV0002", "HV0005", "HV0009", None], "string", fares.company) == ["Juno", "Lyft", "HV0009", None]


def test_tip_pct_guards_the_total(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0), (0.0, -5.0)], "t double, a double")
    got = [r[0] for r in df.select(fares.tip_pct(F.col("t"), F.col("a"))).collect()]
    assert got == [25.0, 0.0, 0.0]


def test_normalize(spark):
    values = ["  Accident - Vehicle!!  ", "CAFÉ/Bar_1\t x", "", None]
    assert column(spark, values, "string", text.normalize) == ["accident vehicle ", "café bar_1 x", "", None]


def test_keyword_category_first_list_wins(spark):
    values = ["truck on bridge", "bridge repair", "wet road", "soccer match", "quiet", "", None]
    assert column(spark, values, "string", text.keyword_category) == [
        "traffic_accident", "construction", "weather", "cultural", "other", "other", "other",
    ]


@pytest.mark.parametrize(
    "description, name",
    [
        # Dots are stripped before blanks, so a dot followed by a blank stays.
        ("At Venue (New York) Big Concert. Closures are at the discretion of the NYPD.", "big concert."),
        ("At Venue (New York) Big Concert..Closures are at the discretion of the NYPD.", "big concert"),
        ("At (New York) City Run, Saturday 9am until Sunday", "city run"),
        ("At (NY).Closures are at the discretion of the NYPD on Sunday", None),
        ("No bracket, closures are decided by NYPD, Monday", None),
        ("Parade on Friday (late) ", None),
        ("(a) (b) Street Fair ,, Friday. Closures are up to the NYPD.", "street fair ,, friday."),
        ("nothing here", None),
        ("", None),
        (None, None),
    ],
)
def test_event_name(spark, description, name):
    assert column(spark, [description], "string", lambda c: text.event_name(text.notice_text(c))) == [name]


def test_venues(spark):
    assert column(spark, ["Citi Field", "Madison Square Garden", "Pier 17", "Central Park", "Forest Hills Stadium", "x"], "string", text.venue_level) == [3, 3, 1, None, 2, None]
    assert column(spark, ["game at citi field today", "none"], "string", text.venue_in) == ["citi field", None]


def test_event_groups(spark):
    values = ["Big Concert", "Baseball game", "Comedy night", "Street Fair", "Gala Dinner", "play/show"]
    assert column(spark, values, "string", text.event_group) == ["music", "sports", "shows", "open_air_events", "gala dinner", "shows"]


def test_address_and_url(spark):
    df = spark.createDataFrame([("  12 Main St , APT 4", "queens", "11101.0"), ("5 A", "bronx", "10451")], "a string, b string, z string")
    got = [r[0] for r in df.select(text.address_key(F.col("a"), F.col("b"), F.col("z"))).collect()]
    assert got == ["12 Main St, Queens, NY 11101", "5 A, Bronx, NY 10451"]
    assert column(spark, ["http://a/b/c", "http://a/b/", "", None], "string", text.url_tail) == ["c", "", None, None]


def test_nan_to_null(spark):
    assert column(spark, [1.0, float("nan"), None], "double", text.nan_to_null) == [1.0, None, None]
