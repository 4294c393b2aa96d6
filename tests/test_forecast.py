"""Zone graph, graph autoregression, recursive forecasts and their storage against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow.operators import forecast, panel, zone_graph
from tripflow.session import shared_folder
from tripflow.sources import sinks

HOURS = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(60)]
NEIGHBOURS = {1: [2], 2: [1, 3], 3: [2], 4: []}


@pytest.fixture(scope="module")
def counts():
    draw = np.random.default_rng(3)
    return {zone: draw.poisson(3 + zone, len(HOURS)).astype(float) for zone in NEIGHBOURS}


@pytest.fixture(scope="module")
def rows(spark, counts):
    data = [(zone, hour, int(counts[zone][i])) for zone in counts for i, hour in enumerate(HOURS)]
    return spark.createDataFrame(data, "zone_id int, hour timestamp_ntz, pickups long")


@pytest.fixture(scope="module")
def weights(spark):
    pairs = [(zone, near, 1.0 / len(all_near)) for zone, all_near in NEIGHBOURS.items() for near in all_near]
    return spark.createDataFrame(pairs, "zone_id int, neighbour_id int, weight double")


def test_adjacency_of_shared_edges(spark):
    box = "POLYGON (({0} {1}, {2} {1}, {2} {3}, {0} {3}, {0} {1}))"
    two_parts = "MULTIPOLYGON (((4 0, 6 0, 6 2, 4 2, 4 0)), ((6 0, 8 0, 8 2, 6 2, 6 0)))"
    clockwise = "POLYGON ((0 2, 0 4, 2 4, 2 2, 0 2))"
    zones = [(1, box.format(0, 0, 2, 2)), (2, box.format(2, 0, 4, 2)), (3, two_parts), (4, clockwise), (5, box.format(50, 50, 52, 52)), (6, None)]
    found = zone_graph.zone_adjacency(spark.createDataFrame(zones, "id int, geometry string")).collect()
    assert {(r.zone_id, r.neighbour_id, r.border) for r in found} == {
        (1, 2, 2.0), (2, 1, 2.0), (2, 3, 2.0), (3, 2, 2.0), (1, 4, 2.0), (4, 1, 2.0)
    }


def test_weights_by_border_sum_to_one(spark):
    pairs = spark.createDataFrame([(1, 2, 3.0), (1, 3, 1.0), (2, 1, 3.0)], "zone_id int, neighbour_id int, border double")
    found = {(r.zone_id, r.neighbour_id): r.weight for r in zone_graph.neighbour_weights(pairs, by_border=True).collect()}
    assert found == {(1, 2): 0.75, (1, 3): 0.25, (2, 1): 1.0}


def test_hops_are_repeated_means(rows, weights, counts):
    found = {(r.zone_id, r.hour): r for r in zone_graph.graph_features(rows, weights).collect()}
    assert len(found) == len(HOURS) * len(NEIGHBOURS)

    def mean(values, zone):
        return {z: (sum(values[n] for n in NEIGHBOURS[z]) / len(NEIGHBOURS[z]) if NEIGHBOURS[z] else 0.0) for z in NEIGHBOURS}[zone]

    for i, hour in enumerate(HOURS):
        now = {z: counts[z][i] for z in NEIGHBOURS}
        once = {z: mean(now, z) for z in NEIGHBOURS}
        for z in NEIGHBOURS:
            assert found[z, hour].pickups == now[z]
            assert found[z, hour].pickups_hop_1 == pytest.approx(once[z]) and found[z, hour].pickups_hop_2 == pytest.approx(mean(once, z))


def brute_fit(counts):
    profile = {z: [np.mean(counts[z][h::24]) for h in range(24)] for z in counts}
    dev = {z: np.array([counts[z][i] - profile[z][i % 24] for i in range(len(HOURS))]) for z in counts}
    near = {z: np.mean([dev[n] for n in NEIGHBOURS[z]], axis=0) if NEIGHBOURS[z] else np.zeros(len(HOURS)) for z in counts}
    x = np.array([[dev[z][i - 1], near[z][i - 1]] for z in counts for i in range(1, len(HOURS))])
    y = np.array([dev[z][i] for z in counts for i in range(1, len(HOURS))])
    return profile, np.linalg.lstsq(x, y, rcond=None)[0]


def test_graph_model_is_least_squares(rows, weights, counts):
    model = forecast.fit_graph(rows, weights)
    assert [model.own, model.near] == pytest.approx(brute_fit(counts)[1].tolist())


def test_constant_demand_has_no_coefficients(spark, weights):
    flat = spark.createDataFrame([(1, hour, 5) for hour in HOURS], "zone_id int, hour timestamp_ntz, pickups long")
    model = forecast.fit_graph(flat, weights)
    assert (model.own, model.near) == (0.0, 0.0)


@pytest.mark.parametrize("per_job", [1, 4])
def test_recursion_feeds_on_its_predictions(spark, rows, weights, counts, per_job):
    model = forecast.fit_graph(rows, weights)
    starts = forecast.histories(rows, 3).where(F.hour("start").isin(5, 20))
    made = forecast.recursive_forecast(starts, rows.select("zone_id", "hour"), forecast.graph_step(model), 6, per_job).collect()
    profile, _ = brute_fit(counts)
    expected = {}
    for s in range(3, len(HOURS)):
        if HOURS[s].hour not in (5, 20):
            continue
        now = {z: counts[z][s - 1] for z in NEIGHBOURS}
        for step in range(6):
            if s + step >= len(HOURS):
                break
            dev = {z: now[z] - profile[z][(s + step - 1) % 24] for z in NEIGHBOURS}
            near = {z: np.mean([dev[n] for n in NEIGHBOURS[z]]) if NEIGHBOURS[z] else 0.0 for z in NEIGHBOURS}
            now = {z: max(0.0, profile[z][(s + step) % 24] + model.own * dev[z] + model.near * near[z]) for z in NEIGHBOURS}
            for z in NEIGHBOURS:
                expected[HOURS[s], z, step + 1] = (HOURS[s + step], now[z])
    assert {(r.start, r.zone_id, r.step) for r in made} == set(expected)
    for r in made:
        hour, value = expected[r.start, r.zone_id, r.step]
        assert r.hour == hour and r.predicted == pytest.approx(value)


def test_errors_count_whole_horizons_only(spark, rows):
    starts = forecast.histories(rows.where("zone_id < 4"), 12)

    def last(df):
        return df.withColumn("predicted", F.element_at("history", -1))

    made = forecast.recursive_forecast(starts, rows.select("zone_id", "hour"), last, 4, 2)
    got = {r.horizon: r for r in forecast.horizon_errors(made, rows, (2, 4)).collect()}
    data = rows.where("zone_id < 4")
    known = panel.multi_horizon_error(data, data, (2, 4)).where("model = 'last_value'").collect()
    for r in known:
        one = got[r.horizon]
        assert (one.windows, one.mse, one.mae, one.cumulative_error) == (r.windows, pytest.approx(r.mse), pytest.approx(r.mae), pytest.approx(r.cumulative_error))


def test_a_rerun_replaces_only_its_day(spark):
    path = shared_folder(spark, "predictions")

    def table(value):
        return spark.createDataFrame([(0, 1, value), (1, 1, value)], "hour int, zone_id int, predicted_pickups double")

    for service, day, value in (("yellow", "2024-01-01", 1.0), ("yellow", "2024-01-02", 2.0), ("fhvhv", "2024-01-01", 3.0), ("yellow", "2024-01-01", 4.0)):
        sinks.save_predictions(table(value), path, service, day)
    for service, day, value in (("yellow", "2024-01-01", 4.0), ("yellow", "2024-01-02", 2.0), ("fhvhv", "2024-01-01", 3.0)):
        assert [r.predicted_pickups for r in sinks.load_predictions(spark, path, service, day).collect()] == [value, value]


def test_written_steps_replace_older_ones(spark):
    import os

    written = []
    first = sinks.land(spark.range(3), "step", written)
    old = written[0]
    second = sinks.land(first.withColumn("x", F.col("id") * 2), "step", written)
    assert not os.path.exists(old) and second.count() == 3 and len(written) == 1


def test_stored_models_are_read_in_a_new_session(spark, rows, weights):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from tripflow.operators import models

    path = shared_folder(spark, "models")
    model = forecast.fit_graph(rows, weights)
    forecast.save_graph(model, f"{path}/graph")
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["pickups"], outputCol="features")]).fit(rows)
    models.save_model(pipeline, f"{path}/ml", "1")
    other = spark.newSession()
    again = forecast.load_graph(other, f"{path}/graph")
    assert (again.own, again.near) == (model.own, model.near) and again.profile.count() == len(NEIGHBOURS)
    assert models.load_model(f"{path}/ml", "1").transform(rows).where("features is null").isEmpty()
    with pytest.raises(Exception, match="exists"):
        models.save_model(pipeline, f"{path}/ml", "1")
