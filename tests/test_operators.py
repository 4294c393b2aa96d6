"""Invariants and brute-force comparisons of the operators."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow.operators import events, joins, levels, lookups, panel, places, quantiles, rollups, scoring, spatial, stats
from tripflow.plans import inputs
from tripflow.session import shared_folder
from tripflow.sources import sinks, trips
from tripflow.sources.reference_data import zone_dimension


# ---- percentiles ------------------------------------------------------------

def test_exact_percentiles_match_sorting(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", round(rng.lognormvariate(2, 1.5), 2)) for _ in range(5000)]
    rows += [(None, 1.0), ("hot", None), ("one", -3.25)]
    df = spark.createDataFrame(rows, "g string, v double")
    cuts = {"p1": 0.01, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    got = {r["g"]: r for r in quantiles.exact_percentiles(df, ["g"], "v", cuts).collect()}
    for group in {g for g, v in rows if v is not None}:
        values = sorted(v for g, v in rows if g == group and v is not None)
        for name, p in cuts.items():
            assert got[group][name] == values[max(math.ceil(p * len(values)), 1) - 1], (group, name)


@pytest.mark.parametrize("resolution", [1, 100, 100_000])
def test_percentiles_do_not_depend_on_the_ranges(spark, resolution):
    values = [float(v) for v in np.random.default_rng(2).normal(0, 50, 999).round(1)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = quantiles.exact_percentiles(df, [], "v", {"m": 0.5, "h": 0.95}, resolution=resolution).first()
    assert (row["m"], row["h"]) == (sorted(values)[499], sorted(values)[949])


def test_nearest_percentile(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    row = quantiles.exact_percentiles(df, [], "v", {"q": 0.1, "r": 0.9}, nearest=True).first()
    assert (row["q"], row["r"]) == (1.0, 9.0)


@pytest.mark.parametrize("most", [10, 10_000])
def test_percentiles_of_values_close_together(spark, most):
    """A narrow band is narrowed until a range holds few distinct values."""
    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), (1000 + F.pow(F.col("id") / 30_000, F.lit(9.0)) * 5).alias("v"))
    cuts = {"low": 0.0, "q1": 0.25, "mid": 0.5, "top": 1.0}
    got = {r.g: r for r in quantiles.exact_percentiles(df, ["g"], "v", cuts, most=most).collect()}
    for g in range(3):
        values = sorted(1000 + (i / 30_000) ** 9 * 5 for i in range(g, 30_000, 3))
        for name, p in cuts.items():
            assert got[g][name] == pytest.approx(values[max(int(np.ceil(p * 10_000)), 1) - 1], rel=1e-14)


def test_percentiles_with_nan_and_infinity(spark):
    values = [float("nan"), 1.0, -3.5, float("inf"), float("-inf"), None, -0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = quantiles.exact_percentiles(df, [], "v", {"a": 0.0, "b": 0.3, "m": 0.5, "z": 0.8, "n": 1.0}).first()
    assert tuple(row)[:4] == (float("-inf"), -3.5, 0.0, float("inf")) and row.n != row.n
    assert quantiles.exact_percentiles(df.limit(0), ["v"], "v", {"m": 0.5}).collect() == []


def test_mode_prefers_the_smallest(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (2.0,), (None,)], "v double")
    assert quantiles.exact_mode(df, "v").first()[0] == 1.0


# ---- joins ------------------------------------------------------------------

@pytest.fixture(params=["10m", "-1"], ids=["broadcast", "shuffled"])
def join_size(spark, request):
    """The same joins with and without small tables being broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.set(key, before)


def skewed_fact(spark):
    return spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("int").alias("k"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_dimension_equals_a_plain_join(spark, join_size, how):
    fact = skewed_fact(spark).withColumn("tags", F.create_map(F.lit("name"), F.col("id")))
    dim = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    got = joins.join_dimension(fact, dim, ["k"], how)
    want = fact.join(dim, "k", how)
    columns = ["id", "k", "v"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_salted_outer_join_keeps_rows_failing_the_condition(spark):
    fact = skewed_fact(spark)
    dim = spark.range(50).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    fact = fact.withColumn("tags", F.create_map(F.lit("name"), F.col("id")))
    got = joins.salted_join(fact, dim, ["k"], "left", F.col("v") < 100)
    assert got.count() == fact.count()
    assert got.where("v is null").select(F.min("k")).first()[0] == 10


def test_zone_dimension_keeps_all_ids_once(spark):
    rows = [(1, "b"), (1, "a"), (265, "z"), (266, "x"), (1000, "w"), (0, "y"), (None, "n")]
    df = spark.createDataFrame(rows, "id int, name string")
    want = [(0, "y"), (1, "a"), (265, "z"), (266, "x"), (1000, "w")]
    assert sorted(map(tuple, zone_dimension(df, "id", "name").collect())) == want


# ---- space ------------------------------------------------------------------

def brute_inside(polygons, x, y):
    crossings = 0
    for ring in (ring for polygon in polygons for ring in polygon):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                crossings += 1
    return crossings % 2 == 1


def star(rng, cx, cy, radius, n):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + radius * rng.uniform(0.4, 1) * math.cos(a), cy + radius * rng.uniform(0.4, 1) * math.sin(a)) for a in angles]
    return ring + ring[:1]


def wkt(polygons):
    def ring_text(ring):
        return "(" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + ")"

    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(ring_text, p)) + ")" for p in polygons) + ")"


@pytest.mark.parametrize("classes", [1, 6])
def test_within_matches_brute_force(spark, join_size, monkeypatch, classes):
    monkeypatch.setattr(spatial, "CLASSES", classes)
    rng = random.Random(5)
    shapes = {}
    for i in range(6):
        cx, cy = (i % 3) * 10 - 7.0, (i // 3) * 10 - 4.0
        shell = star(rng, cx, cy, 4, 25)
        hole = [(cx - 0.3, cy - 0.3), (cx + 0.3, cy - 0.3), (cx + 0.3, cy + 0.3), (cx - 0.3, cy + 0.3), (cx - 0.3, cy - 0.3)]
        shapes[i] = [[shell, hole], [star(rng, cx + 4.5, cy + 4.5, 0.4, 7)]]
    shapes[6], shapes[7] = [[star(rng, 3, 2, 14, 40)]], [[star(rng, 3, 2, 0.2, 9)]]
    zones = spark.createDataFrame([(i, wkt(p)) for i, p in shapes.items()], "id int, geometry string")
    points = [(j, rng.uniform(-13, 20), rng.uniform(-10, 13)) for j in range(400)]
    points += [(400 + j, 3 + rng.uniform(-0.3, 0.3), 2 + rng.uniform(-0.3, 0.3)) for j in range(60)] + [(500, None, 1.0)]
    df = spark.createDataFrame(points, "j int, x double, y double").withColumn("tags", F.create_map(F.lit("name"), F.col("j")))
    got = {}
    for row in spatial.within(df, zones, "x", "y", "left").collect():
        got.setdefault(row["j"], set()).add(row["id"])
    for j, x, y in points:
        want = {i for i, p in shapes.items() if x is not None and brute_inside(p, x, y)} or {None}
        assert got[j] == want


def test_one_large_zone_does_not_multiply_the_cells(spark):
    def box(x, y, size):
        return f"POLYGON (({x} {y}, {x + size} {y}, {x + size} {y + size}, {x} {y + size}, {x} {y}))"

    rows = [(i, box(i % 20 * 0.01, i // 20 * 0.01, 0.01)) for i in range(200)] + [(200, box(0, 0, 30))]
    cells = spatial.grid_cells(spark.createDataFrame(rows, "id int, geometry string"))
    per_zone = {r.id: r["count"] for r in cells.groupBy("id").count().collect()}
    assert len(per_zone) == 201 and max(per_zone.values()) <= 81 + 2 * 9 + 1
    assert cells.where("id = 200 AND whole").count() == 36


def test_borders_belong_to_one_box(spark):
    boxes = [(f"{i}", f"POLYGON (({i} 0, {i + 1} 0, {i + 1} 1, {i} 1, {i} 0))") for i in range(3)]
    zones = spark.createDataFrame(boxes, "id string, geometry string")
    points = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5), (3.0, 0.5), (2.0, 1.0), (2.5, 0.0)], "x double, y double")
    got = {(r["x"], r["y"]): r["id"] for r in spatial.within(points, zones, "x", "y", "left").collect()}
    assert got == {(0.0, 0.0): "0", (1.0, 0.5): "1", (3.0, 0.5): None, (2.0, 1.0): None, (2.5, 0.0): "2"}


def test_area_counts_holes_in_any_direction(spark):
    same = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    other = "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    df = spark.createDataFrame([(1, same), (2, other)], "id int, geometry string")
    for row in spatial.geometry_stats(df).collect():
        assert row["area"] == pytest.approx(15)
        assert row["length"] == pytest.approx(20)
        assert row["centroid_x"] == pytest.approx((16 * 2 - 1.5) / 15)


def test_state_plane_round_trip_and_scale(spark):
    df = spark.createDataFrame([(-74.0, 40 + 10 / 60), (-73.98, 40.75), (-73.7, 40.5)], "lon double, lat double")
    plane = df.withColumn("p", spatial.to_state_plane(F.col("lon"), F.col("lat")))
    rows = plane.withColumn("b", spatial.from_state_plane(F.col("p.x"), F.col("p.y"))).collect()
    assert rows[0]["p"]["x"] == pytest.approx(984250.0, abs=0.01)
    assert rows[0]["p"]["y"] == pytest.approx(0.0, abs=0.01)
    for row in rows:
        assert row["b"]["lon"] == pytest.approx(row["lon"], abs=1e-9)
        assert row["b"]["lat"] == pytest.approx(row["lat"], abs=1e-9)


def test_zone_sizes_in_miles(spark):
    d = 0.01
    box = f"POLYGON ((-74 40.7, {-74 + d} 40.7, {-74 + d} {40.7 + d}, -74 {40.7 + d}, -74 40.7))"
    row = spatial.zone_sizes(spark.createDataFrame([(1, box)], "id int, geometry string")).first()
    # One hundredth of a degree there: 0.6901 miles north, 0.5250 miles east.
    assert row["area_miles2"] == pytest.approx(0.6901 * 0.5250, rel=0.002)
    assert row["lat"] == pytest.approx(40.705, abs=1e-5)
    assert row["lon"] == pytest.approx(-73.995, abs=1e-5)


def test_dissolve_cancels_shared_edges(spark):
    boxes = [("a", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"), ("a", "POLYGON ((1 0, 1 1, 2 1, 2 0, 1 0))"), ("b", "POLYGON ((5 5, 6 5, 6 6, 5 6, 5 5))")]
    df = spark.createDataFrame(boxes, "g string, geometry string")
    outer = spatial.dissolve(spatial.zone_edges(df), "g").collect()
    assert sum(r["g"] == "a" for r in outer) == 6
    assert sum(r["g"] == "b" for r in outer) == 4


# ---- panel ------------------------------------------------------------------

@pytest.fixture(scope="module")
def small_panel(spark):
    rng = random.Random(3)
    rows = [(z, datetime(2024, 1, 1) + timedelta(hours=h), rng.randrange(9)) for z in (1, 2) for h in range(60)]
    return spark.createDataFrame(rows, "zone_id int, hour timestamp_ntz, pickups bigint").cache()


def test_panel_is_dense_and_half_open(spark):
    zones = spark.createDataFrame([(1,), (2,), (3,)], "LocationID int")
    rides = [(datetime(2024, 1, 1, 0, 59), 1), (datetime(2024, 1, 1, 0, 1), 1), (datetime(2024, 1, 2), 1), (datetime(2023, 12, 31, 23), 2), (datetime(2024, 1, 1, 5), 9)]
    df = spark.createDataFrame(rides, "pickup_datetime timestamp_ntz, PULocationID bigint")
    rows = panel.demand_panel(df, zones, "2024-01-01", "2024-01-02").collect()
    assert len(rows) == 3 * 24
    assert sum(r["pickups"] for r in rows) == 2
    assert max(r["hour"] for r in rows) == datetime(2024, 1, 1, 23)


def test_fill_gaps(spark):
    values = {1: [None, 2.0, None, 3.0, None], 2: [None] * 5}
    rows = [(z, datetime(2024, 1, 1, h), v) for z, vs in values.items() for h, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "zone_id int, hour timestamp_ntz, w double")
    got = [r["w"] for r in panel.fill_gaps(df, ["w"]).orderBy("zone_id", "hour").collect()]
    assert got == [2.0, 2.0, 2.0, 3.0, 3.0] + [0.0] * 5


def test_windows(small_panel):
    rows = panel.sliding_windows(small_panel, ["pickups"]).collect()
    assert len(rows) == 2 * (60 - 12)
    assert {len(r["pickups_history"]) for r in rows} == {12}
    series = [r["pickups"] for r in small_panel.where("zone_id = 1").orderBy("hour").collect()]
    first = min((r for r in rows if r["zone_id"] == 1), key=lambda r: r["hour"])
    assert (first["pickups_history"], first["target"]) == (series[:12], series[12])


def test_short_series_has_no_window(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, h), 1) for h in range(11)], "zone_id int, hour timestamp_ntz, pickups bigint")
    assert panel.sliding_windows(df, ["pickups"]).count() == 0


def test_unknown_feature(spark, small_panel, sf):
    with pytest.raises(ValueError, match="not found"):
        panel.feature_panel(small_panel, inputs.weather(spark, sf), ["pickups", "moonlight"])


def test_weather_features_are_not_all_zero(spark, sf):
    zones = inputs.zones(spark, sf)
    grid = panel.demand_panel(inputs.yellow_loaded(spark, sf), zones, "2024-01-02", "2024-01-05")
    full = panel.feature_panel(grid, inputs.weather(spark, sf))
    assert full.where("temperature_2m <> 0").count() > 0
    assert full.where("temperature_2m is null").count() == 0


def test_multi_horizon_matches_a_loop(small_panel):
    train = small_panel.where(F.col("hour") < datetime(2024, 1, 2, 12))
    test = small_panel.where(F.col("hour") >= datetime(2024, 1, 2, 0))
    got = {(r["model"], r["horizon"]): r for r in panel.multi_horizon_error(train, test, (2, 4), 6).collect()}
    data = {z: [r["pickups"] for r in test.where(f"zone_id = {z}").orderBy("hour").collect()] for z in (1, 2)}
    means = {(r["zone_id"], r["hour_of_day"]): r["predicted"] for r in panel.hour_means(train, 6).collect()}
    for horizon in (2, 4):
        errors = {"hour_mean": [], "last_value": []}
        for z, ys in data.items():
            for s in range(6, len(ys) - horizon + 1):
                future = ys[s : s + horizon]
                hours = [(s + k) % 24 for k in range(horizon)]
                errors["hour_mean"].append([round(means.get((z, h), 0.0)) - y for h, y in zip(hours, future)])
                errors["last_value"].append([ys[s - 1] - y for y in future])
        for model, lists in errors.items():
            row = got[(model, horizon)]
            flat = [e for es in lists for e in es]
            assert row["windows"] == len(lists)
            assert row["mse"] == pytest.approx(np.mean(np.square(flat)))
            assert row["mae"] == pytest.approx(np.mean(np.abs(flat)))
            assert row["cumulative_error"] == pytest.approx(np.mean([abs(sum(es)) for es in lists]))


# ---- shares, levels, scaling ------------------------------------------------

def test_shares_sum_to_hundred(spark, sf):
    trips_df = inputs.yellow_trips(spark, sf)
    for row in rollups.share_of_hour(trips_df).groupBy("pickup_hour").agg(F.sum("percentage").alias("s")).collect():
        assert row["s"] == pytest.approx(100)
    total = rollups.od_flows(trips_df, n=None).agg(F.sum("pct_of_all")).first()[0]
    assert total == pytest.approx(100)


def test_scaling_guards(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    rows = levels.minmax_scale(df, ["a", "b"]).collect()
    assert [r["a_norm"] for r in rows] == [0.0, 1.0, None]
    assert {r["b_norm"] for r in rows} == {0.0}


def test_levels_of_equal_counts(spark):
    df = spark.createDataFrame([("night", f"z{i}") for i in range(5)], "time_of_day string, pickup_zone string")
    assert {(r["level"], r["avg_level"]) for r in levels.demand_levels(df).collect()} == {("Very Low", "Very Low")}


def test_band_columns_add_up(spark, sf):
    bands = rollups.pickups_by_band(inputs.all_trips(spark, sf))
    total = bands.agg(F.sum(sum(F.col(f"pickups_{b}") for b in ("morning", "afternoon", "evening", "night")))).first()[0]
    assert total == inputs.all_trips(spark, sf).count()


def test_approximate_and_exact_median_agree(spark, sf):
    df = inputs.all_trips(spark, sf)
    exact = {r["PULocationID"]: r["median_fare"] for r in rollups.zone_demand(df).collect()}
    sketch = {r["PULocationID"]: r["median_fare"] for r in rollups.zone_demand(df, exact_median=False).collect()}
    assert exact == sketch


# ---- sampling ---------------------------------------------------------------

def test_sample_ignores_partitioning(spark):
    df = spark.range(20000).withColumn("stratum", F.col("id") % 24)
    one = stats.stratified_sample(df, ["id"], 0.05)
    other = stats.stratified_sample(df.repartition(13), ["id"], 0.05)
    ids = {r["id"] for r in one.collect()}
    assert ids == {r["id"] for r in other.collect()}
    per_stratum = one.groupBy("stratum").count().collect()
    assert len(per_stratum) == 24
    assert all(15 <= r["count"] <= 75 for r in per_stratum)
    assert ids != {r["id"] for r in stats.stratified_sample(df, ["id"], 0.05, seed=7).collect()}


def test_exact_sample_sizes_with_a_hot_stratum(spark):
    df = spark.range(9000).withColumn("stratum", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")))
    sizes = {r["stratum"]: r["count"] for r in df.groupBy("stratum").count().collect()}
    sample = stats.exact_stratified_sample(df, "stratum", ["id"], 0.07)
    got = {r["stratum"]: r["count"] for r in sample.groupBy("stratum").count().collect()}
    assert got == {s: math.ceil(n * 0.07) for s, n in sizes.items()}
    assert sample.distinct().count() == sample.count()


def test_p_value():
    # r = 0.5 with 20 pairs: t = 2.4495 on 18 degrees of freedom, p = 0.0248
    assert stats.pearson_p_value(0.5, 20) == pytest.approx(0.0248, abs=2e-4)
    assert stats.pearson_p_value(0.0, 30) == pytest.approx(1.0, abs=1e-6)


def test_p_value_column(spark):
    cases = [(0.5, 20), (0.0, 30), (-0.9, 5), (0.03, 4000), (1.0, 9), (0.4, 3)]
    df = spark.createDataFrame(cases, "r double, n int").select("r", "n", stats.correlation_p_value(F.col("r"), F.col("n")).alias("p"))
    for row in df.collect():
        assert row.p == pytest.approx(stats.pearson_p_value(row.r, row.n), abs=1e-6)
    assert spark.range(1).select(stats.correlation_p_value(F.lit(0.1), F.lit(2)).alias("p")).first().p is None


# ---- places -----------------------------------------------------------------

def test_closing_reasons(spark):
    tags = [
        {"name": "a"}, {"disused:shop": "yes"}, {"was:amenity": None}, {"disused": "yes"}, {"disused": ""},
        {"construction:shop": "mall"}, {"construction:bridge": "x"}, {"opening_date": "2026"}, {"opening_date": "2025-11"},
        {"start_date": "2025-12-01"}, {"start_date": "soon"}, {"start_date": "2025-11-30"},
    ]
    df = spark.createDataFrame([(t,) for t in tags], "tags map<string,string>")
    got = [r[0] for r in df.select(places.closing_reason(F.col("tags"), "2025-11-30")).collect()]
    assert got == [
        None, "disused:shop", None, "disused", None, "construction:shop", None, "opening_date=2026", None,
        "start_date=2025-12-01", None, None,
    ]


def test_density_of_a_zone_without_area(spark):
    df = spark.createDataFrame([(1, 0.0, 5), (2, 2.0, 5), (3, 4.0, 0)], "id int, area_miles2 double, food bigint")
    assert [r["food_per_mi2"] for r in places.density(df, ["food"]).orderBy("id").collect()] == [0.0, 2.5, 0.0]


def test_bottom_list_without_enough_positives(spark):
    df = spark.createDataFrame([(i, f"z{i}", float(max(0, i - 5))) for i in range(1, 8)], "id int, zone string, food double")
    rows = places.top_bottom(df, ["food"]).collect()
    assert sorted(r["id"] for r in rows if r["side"] == "bottom") == [1, 2, 3, 4, 5]
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["side"] == "top"] == [7, 6, 1, 2, 3]


# ---- events -----------------------------------------------------------------

def notice(i, subtype, road, start, text, lat=1.0, lon=2.0):
    schedule = [(start, start)] if start else None
    return (str(i), "specialEvents", subtype, "New York City Area", road, lat, lon, "County", schedule, text)


def test_impacts_match_only_single_events(spark):
    from tripflow.schemas import EVENT_FEED

    day, other = "05/01/2024 18:00:00", "06/01/2024 18:00:00"
    rows = [
        notice(1, "Concert", "Citi Field", day, "(x) Big Concert, Friday"),
        notice(2, "Baseball game", "Pier 17", day, "(x) Game A, Friday"),
        notice(3, "Baseball game", "Pier 17", day, "(x) Game B, Friday"),
        notice(4, "Concert", "W 1 St", day, "at citi field (ny) Big Concert, Friday"),
        notice(5, "Concert", "W 1 St", day, "at citi field (ny) Big Concert, Friday", 3.0),
        notice(6, "Concert", "W 2 St", day, "at citi field (ny) Big Concert, Friday"),
        notice(7, "Baseball game", "W 3 St", day, "near pier 17 (ny) Game A, Friday"),
        notice(8, "Baseball game", "W 4 St", day, "near pier 17 (ny) Game A, Friday", 3.0, 4.0),
        notice(9, "Concert", "W 5 St", other, "at citi field (ny) Lone, Friday"),
        notice(10, "Concert", "W 6 St", other, "no name here"),
        notice(11, "Operational activity", "W 7 St", day, "(ny) Works, Friday"),
        notice(12, "Special event permit", "W 8 St", day, "(ny) Works, Friday"),
    ]
    prepared = events.prepare_notices(spark.createDataFrame(rows, EVENT_FEED))
    got = {r["ID"]: r for r in events.event_table(prepared).collect()}
    assert set(got) == {"1", "2", "3", "7", "9"}
    assert [s["Street"] for s in got["1"]["RoadsAffected"]] == ["W 1 St", "W 2 St"]
    assert (got["1"]["CountRoadsAffected"], got["1"]["RoadsAffected"][0]["Latitude"]) == (2, 1.0)
    assert (got["2"]["CountRoadsAffected"], got["3"]["RoadsAffected"]) == (0, None)
    assert (got["7"]["RoadwayName"], got["7"]["Latitude"], got["7"]["Longitude"]) == ("SEVERAL STREETS", 2.0, 3.0)
    assert (got["9"]["RoadwayName"], got["9"]["CountRoadsAffected"]) == ("W 5 St", 0)
    assert (got["1"]["AsistanceLevel"], got["2"]["AsistanceLevel"]) == (3, 1)


def test_camera_lists(spark):
    rows = [("c1", "u/1", None, 1), ("c2", None, None, 1), ("c3", None, None, 2)]
    df = spark.createDataFrame(rows, "ID string, Url string, VideoUrl string, id_zone int").withColumns({"zone": F.lit("z"), "borough": F.lit("b")})
    got = {r["id_zone"]: r for r in events.cameras_by_zone(df).collect()}
    assert (got[1]["num_cameras"], got[1]["cameras_ids"], got[1]["video_urls"]) == (2, ["1", ""], None)
    assert got[2]["cameras_ids"] is None


# ---- scoring ----------------------------------------------------------------

def test_top2_labels(spark):
    probs = [f"prob_class_{i}" for i in range(5)]
    rows = [(0.1, 0.5, 0.3, 0.05, 0.05), (0.5, 0.1, 0.3, 0.05, 0.05), (0.2, 0.2, 0.2, 0.2, 0.2)]
    df = spark.createDataFrame(rows, ", ".join(f"{p} double" for p in probs))
    got = [r[0] for r in df.select(scoring.top2_label(probs, digits=2)).collect()]
    assert got == ["$1-2 & $2-3: 0.8", "$0: 0.5 | $2-3: 0.3", "$0 & $1-2: 0.4"]


def test_perfect_and_empty_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "l int, p int")
    assert {r["f1"] for r in scoring.class_metrics(df, "l", "p").collect()} == {1.0}
    assert scoring.class_metrics(df.limit(0), "l", "p").count() == 0
    wrong = spark.createDataFrame([(0, 1), (0, 1)], "l int, p int")
    assert {r["class"]: (r["actual"], r["predicted"], r["f1"]) for r in scoring.class_metrics(wrong, "l", "p").collect()} == {0: (2, 0, 0.0), 1: (0, 2, 0.0)}


def test_expected_tip_of_a_zone_without_scores(spark):
    zones = spark.createDataFrame([(1, "A", "B"), (2, "C", "D")], "LocationID int, Zone string, Borough string")
    scores = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 0.0, 1.0, 0.0)], "zone_id int, " + ", ".join(f"{p} double" for p in lookups.PROBABILITIES))
    got = {r["zone_id"]: (r["expected_tip_usd"], r["top_category"]) for r in lookups.expected_tip_by_zone(scores, zones).collect()}
    assert got == {1: (5.0, "$3-5"), 2: (0.0, "$0")}


def test_topk_larger_than_the_table(spark):
    df = spark.createDataFrame([(1, "Z", 0, 3.0), (2, "Y", 0, 3.0)], "zone_id int, zone_name string, hour int, predicted_pickups double")
    assert [r["zone_id"] for r in lookups.top_forecast_zones(df, 1, 10).collect()] == [1, 2]


# ---- files ------------------------------------------------------------------

def test_rerun_replaces_only_its_months(spark):
    path = shared_folder(spark, "months")
    rows = [(2024, 1, 1.0), (2024, 2, 2.0), (2024, 2, 3.0)]
    df = spark.createDataFrame(rows, "pickup_year int, pickup_month int, v double")
    sinks.save_trips(df, path)
    sinks.save_trips(df.where("pickup_month = 2").withColumn("v", F.lit(9.0)), path)
    got = sorted((r["pickup_month"], r["v"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1.0), (2, 9.0), (2, 9.0)]


def test_result_table_is_reused(spark):
    path = shared_folder(spark, "result")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert sinks.result_table(spark, path, compute).count() == 3
    assert sinks.result_table(spark, path, compute).count() == 3
    assert len(calls) == 1
    sinks.result_table(spark, path, compute, reuse=False)
    assert len(calls) == 2


def test_drifting_files(spark):
    early = spark.createDataFrame([(1, 2.0)], "VendorID int, Airport_fee double")
    late = spark.createDataFrame([(2, 3)], "vendorid bigint, extra int")
    rows = trips.union_drifting([early, late], {"VendorID": "bigint", "airport_fee": "double"}).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, 2.0), (2, None)]


# ---- dissolved rings ----------------------------------------------------------

def test_dissolved_rings_with_holes_islands_and_touching_corners(spark):
    def box(x0, y0, x1, y1, clockwise=False):
        points = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        return "(" + ", ".join(f"{x} {y}" for x, y in (points[::-1] if clockwise else points)) + ")"

    frame = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rows = [("frame", f"POLYGON ({box(x, y, x + 1, y + 1, clockwise=(x + y) % 2 == 1)})") for x, y in frame]
    rows += [("corners", f"POLYGON ({box(0, 0, 1, 1)})"), ("corners", f"POLYGON ({box(1, 1, 2, 2)})")]
    rows += [("island", f"POLYGON ({box(0, 0, 9, 9)}, {box(2, 2, 7, 7)})"), ("island", f"POLYGON ({box(3, 3, 6, 6)}, {box(4, 4, 5, 5)})")]
    rows += [(None, f"MULTIPOLYGON (({box(0, 0, 1, 1)}), ({box(1, 0, 2, 1)}))"), ("none", None)]
    found = spatial.dissolve_rings(spark.createDataFrame(rows, "g string, geometry string"), "g").collect()
    got = {}
    for r in found:
        points = [(p.x, p.y) for p in r.points]
        assert points[0] == points[-1] == min(points) and len(set(points)) == len(points) - 1
        assert (r.area > 0) == (r.ring == 0)
        got.setdefault(r.g, []).append((r.polygon, r.ring, r.area, len(points) - 1))
    assert {g: sorted(v) for g, v in got.items()} == {
        "frame": [(0, 0, 9.0, 12), (0, 1, -1.0, 4)],
        "corners": [(0, 0, 1.0, 4), (1, 0, 1.0, 4)],
        "island": [(0, 0, 81.0, 4), (0, 1, -25.0, 4), (1, 0, 9.0, 4), (1, 1, -1.0, 4)],
        None: [(0, 0, 2.0, 6)],
    }


def test_overlapping_zones_are_refused(spark):
    rows = [("g", "POLYGON ((0 0, 2 0, 2 2, 0 0))"), ("g", "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))")]
    with pytest.raises(ValueError, match="overlap"):
        spatial.dissolve_rings(spark.createDataFrame(rows, "g string, geometry string"), "g")
