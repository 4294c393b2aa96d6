"""Registered queries of the zone graph, the forecast chain and the models that feed on their own output."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.config import YELLOW
from tripflow.functions.numeric import round_half_up
from tripflow.operators import forecast, lookups, models, panel, stats, zone_graph
from tripflow.plans import inputs
from tripflow.plans.check_sql import query, r
from tripflow.plans.panel_queries import CUT, END, FEATURES, FULL, SPLIT, START, fitted, make_panel, panel_cte
from tripflow.plans.place_queries import box_zones
from tripflow.plans.registry import register
from tripflow.plans.rollup_queries import rounded
from tripflow.plans.source_queries import ts_text
from tripflow.session import shared_folder
from tripflow.sources import sinks
from tripflow.streaming import demand

# ---- zone graph ---------------------------------------------------------------

GRAPH = {
    "boxes": "SELECT LocationID AS id, (LocationID - 1) % 5 * 2 AS l, (LocationID - 1) // 5 * 2 AS b FROM zones",
    # Zone 13 has two narrow parts, so only its upright sides match those of its neighbours.
    "sides": "SELECT id, l AS x1, b AS y1, l AS x2, b + 2 AS y2 FROM boxes UNION ALL SELECT id, l + 2, b, l + 2, b + 2 FROM boxes "
    "UNION ALL SELECT id, l, b, l + 2, b FROM boxes WHERE id <> 13 UNION ALL SELECT id, l, b + 2, l + 2, b + 2 FROM boxes WHERE id <> 13",
    "adjacency": "SELECT one.id AS zone_id, two.id AS neighbour_id, CAST(2 * count(*) AS DOUBLE) AS border FROM sides one JOIN sides two USING (x1, y1, x2, y2) WHERE one.id <> two.id GROUP BY 1, 2",
    "weights": "SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY zone_id) AS weight FROM adjacency",
}


def adjacency(spark, sf):
    return zone_graph.zone_adjacency(box_zones(spark, sf))


def weights(spark, sf):
    """Neighbour weights, stored once: every step of a forecast reads them."""
    return inputs.landed(
        spark, sf, "zone_weights", lambda p: zone_graph.neighbour_weights(adjacency(spark, sf)).write.parquet(p)
    )


@register("zone_adjacency", query("SELECT * FROM adjacency", GRAPH))
def zone_adjacency(spark, sf):
    return adjacency(spark, sf)


@register(
    "graph_features",
    query(
        f"SELECT p.zone_id, strftime(p.hour, '%Y-%m-%d %H:%M:%S') AS hour, p.pickups, {r('coalesce(one.v, 0)', 6)} AS pickups_hop_1, {r('coalesce(two.v, 0)', 6)} AS pickups_hop_2 "
        "FROM test_panel p LEFT JOIN hop_one one USING (zone_id, hour) LEFT JOIN hop_two two USING (zone_id, hour)",
        {
            **SPLIT, **GRAPH,
            "hop_one": "SELECT w.zone_id, p.hour, sum(p.pickups * weight) AS v FROM weights w JOIN test_panel p ON p.zone_id = neighbour_id GROUP BY 1, 2",
            "hop_two": "SELECT w.zone_id, o.hour, sum(o.v * weight) AS v FROM weights w JOIN hop_one o ON o.zone_id = neighbour_id GROUP BY 1, 2",
        },
    ),
)
def graph_features(spark, sf):
    df = zone_graph.graph_features(make_panel(spark, sf, CUT, END), weights(spark, sf))
    return ts_text(rounded(df, pickups_hop_1=6, pickups_hop_2=6), "hour")


# ---- graph autoregression -------------------------------------------------------


def model_ctes(train):
    """Profile, coefficients and, as lists by hour of day and zone, what a step needs."""
    return {
        **GRAPH,
        "profile": f"SELECT zone_id, hour(hour) AS h, avg(pickups) AS profile FROM {train} GROUP BY 1, 2",
        "dev": f"SELECT t.zone_id, t.hour, t.pickups - profile AS now FROM {train} t JOIN profile q ON q.zone_id = t.zone_id AND q.h = hour(t.hour)",
        "dev_near": "SELECT w.zone_id, d.hour, sum(weight * now) AS near FROM weights w JOIN dev d ON d.zone_id = neighbour_id GROUP BY 1, 2",
        "pairs": "SELECT d.now, o.now AS own, coalesce(near, 0) AS near FROM dev d JOIN dev o ON o.zone_id = d.zone_id AND o.hour = d.hour - INTERVAL 1 HOUR LEFT JOIN dev_near n ON n.zone_id = o.zone_id AND n.hour = o.hour",
        "sums": "SELECT sum(own * own) AS oo, sum(own * near) AS en, sum(near * near) AS nn, sum(own * now) AS oy, sum(near * now) AS ny FROM pairs",
        "coefficients": "SELECT (oy * nn - ny * en) / (oo * nn - en * en) AS own, (ny * oo - oy * en) / (oo * nn - en * en) AS near FROM sums",
        "by_hour": "SELECT list(row_of_hour ORDER BY h) AS p FROM (SELECT h, list(profile ORDER BY zone_id) AS row_of_hour FROM profile GROUP BY h)",
        "near_of": "SELECT list(ids ORDER BY id) AS n FROM (SELECT b.id, list(neighbour_id) FILTER (neighbour_id IS NOT NULL) AS ids FROM boxes b LEFT JOIN weights w ON w.zone_id = b.id GROUP BY 1)",
    }


def paths_cte(starts):
    """Values of all zones after each step, from the values in the hour before a start."""
    deviation = "(ys[{0}] - p[(hour(start) + step + 23) % 24 + 1][{0}])"
    nearby = f"coalesce(list_avg(list_transform(n[i], lambda j: {deviation.format('j')})), 0)"
    value = f"p[(hour(start) + step) % 24 + 1][i] + own * {deviation.format('i')} + near * {nearby}"
    return (
        f"SELECT start, 0 AS step, ys FROM {starts} UNION ALL SELECT start, step + 1, list_transform(range(1, 26), lambda i: greatest({value}, 0.0::DOUBLE)) "
        "FROM paths, coefficients, by_hour, near_of WHERE step < 24"
    )


def recursive(body, ctes):
    return query(body, ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@register(
    "demand_graph_model",
    query(f"SELECT {r('own', 6)} AS own, {r('near', 6)} AS near, (SELECT count(*) FROM profile) AS means FROM coefficients", {**SPLIT, **model_ctes("train_panel")}),
)
def demand_graph_model(spark, sf):
    model = graph_model(spark, sf)
    return model.profile.agg(
        round_half_up(F.lit(model.own), 6).alias("own"), round_half_up(F.lit(model.near), 6).alias("near"), F.sum(F.size("profile")).alias("means")
    )


def graph_model(spark, sf):
    def write(path):
        forecast.save_graph(forecast.fit_graph(make_panel(spark, sf, START, CUT), weights(spark, sf)), path)

    return forecast.load_graph(spark, inputs.landed_path(spark, sf, "graph_model", write))


RECURSION = {
    **SPLIT,
    **model_ctes("train_panel"),
    "starts": "SELECT t.hour AS start, list(b.pickups::DOUBLE ORDER BY t.zone_id) AS ys FROM test_panel t JOIN test_panel b ON b.zone_id = t.zone_id AND b.i = t.i - 1 WHERE t.i > 12 GROUP BY 1",
    "paths": paths_cte("starts"),
    "steps": "SELECT start, step, z AS zone_id, ys[z] AS predicted FROM paths, range(1, 26) one(z) WHERE step > 0",
    "errors": "SELECT s.start, s.zone_id, s.step, CAST(round_even(round(predicted, 6), 0) AS BIGINT) - pickups AS e FROM steps s JOIN test_panel t ON t.zone_id = s.zone_id AND t.hour = s.start + to_hours(s.step - 1)",
    "horizons": f"SELECT unnest([{', '.join(map(str, panel.HORIZONS))}]) AS horizon",
    "per_start": "SELECT start, zone_id, horizon, sum(e * e) AS sq, sum(abs(e)) AS ab, sum(e) AS total FROM errors, horizons WHERE step <= horizon GROUP BY 1, 2, 3 HAVING count(*) = horizon",
}


@register(
    "multi_horizon_error_graph",
    recursive(
        f"SELECT CAST(horizon AS INT) AS horizon, count(*) AS windows, {r('sum(sq) / (count(*) * horizon)', 6)} AS mse, {r('sum(ab) / (count(*) * horizon)', 6)} AS mae, {r('avg(abs(total))', 6)} AS cumulative_error FROM per_start GROUP BY horizon",
        RECURSION,
    ),
)
def multi_horizon_error_graph(spark, sf):
    test = make_panel(spark, sf, CUT, END)
    future = test.select("zone_id", "hour")
    made = forecast.recursive_forecast(forecast.histories(test), future, forecast.graph_step(graph_model(spark, sf)), max(panel.HORIZONS))
    return rounded(forecast.horizon_errors(made, test), mse=6, mae=6, cumulative_error=6)


# ---- boosted trees --------------------------------------------------------------


def feature_rows(spark, sf, start, end, name):
    """Feature panel of [start, end), stored once."""

    def write(path):
        panel.feature_panel(make_panel(spark, sf, start, end), inputs.weather(spark, sf), FEATURES).write.parquet(path)

    return inputs.landed(spark, sf, name, write)


def demand_rows(spark, sf, start, end, name):
    full = feature_rows(spark, sf, start, end, f"{name}_panel")
    return inputs.landed(
        spark, sf, name, lambda p: models.demand_features(full, weights(spark, sf), FEATURES).write.parquet(p)
    )


def demand_model(spark, sf):
    return fitted(spark, sf, "demand", lambda: models.fit_demand(demand_rows(spark, sf, START, CUT, "demand_train"), FEATURES))


@register("demand_forecast_ml")
def demand_forecast_ml(spark, sf):
    test = demand_rows(spark, sf, CUT, END, "demand_test")
    return stats.regression_metrics(models.predict_demand(demand_model(spark, sf), test))


@register("multi_horizon_error_ml")
def multi_horizon_error_ml(spark, sf):
    """Each prediction of the trees becomes the next step's lag, over every start and up to 24 steps."""
    test = feature_rows(spark, sf, CUT, END, "demand_test_panel")
    step = models.demand_step(demand_model(spark, sf), weights(spark, sf))
    made = forecast.recursive_forecast(forecast.histories(test), test.drop("pickups"), step, max(panel.HORIZONS))
    return rounded(forecast.horizon_errors(made, test), mse=6, mae=6, cumulative_error=6)


# ---- the stored forecast and its readers ------------------------------------------

#: Name of the model in the path of the stored forecasts.
VERSION = "graph-1"
DAYS = {
    "yellow": (inputs.yellow_loaded, "2024-01-01", "2024-01-30"),
    "fhvhv": (inputs.fhvhv_records, "2000-05-01", "2000-06-15"),
}


def store_forecast(spark, sf, path, service):
    """Fit on all hours before the day and write the day's forecast; a rerun replaces that day of that service."""
    trips, start, day = DAYS[service]
    history = make_panel(spark, sf, start, day, trips)
    model = forecast.fit_graph(history, weights(spark, sf))
    sinks.save_predictions(forecast.day_forecast(model, history, inputs.zones(spark, sf), day), f"{path}/{VERSION}", service, day)


def stored_forecast(spark, sf, service):
    """The forecast of a service as the lookups read it."""

    def write(path):
        for one in DAYS:
            store_forecast(spark, sf, path, one)

    path = inputs.landed_path(spark, sf, "forecasts", write)
    stored = sinks.load_predictions(spark, f"{path}/{VERSION}", service, DAYS[service][2])
    return stored.withColumns({c: F.col(c).cast("int") for c in ("hour", "zone_id")})


def forecast_ctes(service):
    source, (_, start, day) = f"{service}_loaded", DAYS[service]
    return {
        **panel_cte("history", start, day, source),
        **model_ctes("history"),
        "starts": f"SELECT TIMESTAMP '{day}' AS start, list(pickups::DOUBLE ORDER BY zone_id) AS ys FROM history WHERE hour = TIMESTAMP '{day}' - INTERVAL 1 HOUR",
        "paths": paths_cte("starts"),
        "forecast": "SELECT CAST(step - 1 AS INT) AS hour, z AS zone_id, Zone AS zone_name, Borough AS borough, ys[z] AS predicted_pickups FROM paths JOIN range(1, 26) one(z) ON step > 0 JOIN zones ON LocationID = z",
    }


YELLOW_DAY, FHVHV_DAY = forecast_ctes("yellow"), forecast_ctes("fhvhv")


def yellow_forecast(spark, sf):
    return stored_forecast(spark, sf, "yellow").select("hour", "zone_id", "zone_name", "borough", "predicted_pickups")


@register(
    "top_forecast_zones",
    recursive(f"SELECT hour, CAST(zone_id AS INT) AS zone_id, zone_name, borough, {r('predicted_pickups', 6)} AS predicted_pickups FROM forecast WHERE hour = 1 ORDER BY round(forecast.predicted_pickups, 9) DESC, zone_id LIMIT 5", YELLOW_DAY),
)
def top_forecast_zones(spark, sf):
    return rounded(lookups.top_forecast_zones(yellow_forecast(spark, sf), hours_from_now=2), predicted_pickups=6)


@register(
    "zone_forecast",
    recursive(f"SELECT hour, CAST(zone_id AS INT) AS zone_id, zone_name, borough, {r('predicted_pickups', 6)} AS predicted_pickups, CAST(hour + 1 AS INT) AS next_hour FROM forecast WHERE lower(zone_name) LIKE '%airport%' AND hour < 12", YELLOW_DAY),
)
def zone_forecast(spark, sf):
    return rounded(lookups.zone_forecast(yellow_forecast(spark, sf), "airport", 12), predicted_pickups=6)


@register(
    "forecast_intensity",
    recursive(
        f"SELECT hour, CAST(zone_id AS INT) AS zone_id, {r('predicted_pickups', 6)} AS predicted_pickups, {r('greatest(least(predicted_pickups / top, 1), 0)', 6)} AS intensity "
        "FROM (SELECT *, coalesce(nullif(max(predicted_pickups) OVER (PARTITION BY hour), 0), 1) AS top FROM forecast)",
        FHVHV_DAY,
    ),
)
def forecast_intensity(spark, sf):
    df = panel.forecast_intensity(stored_forecast(spark, sf, "fhvhv")).select("hour", "zone_id", "predicted_pickups", "intensity")
    return rounded(df, predicted_pickups=6, intensity=6)


@register(
    "forecast_totals",
    recursive("SELECT hour, CAST(sum(CAST(floor(round(predicted_pickups, 9)) AS BIGINT)) AS BIGINT) AS total_pickups FROM forecast GROUP BY 1", YELLOW_DAY),
)
def forecast_totals(spark, sf):
    return panel.forecast_totals(yellow_forecast(spark, sf).withColumn("predicted_pickups", F.round("predicted_pickups", 9)))


@register(
    "sink_predictions_json",
    recursive(
        f"SELECT 'yellow' AS service, DATE '{DAYS['yellow'][2]}' AS day, hour, CAST(zone_id AS INT) AS zone_id, zone_name, {r('predicted_pickups', 6)} AS predicted_pickups FROM forecast", YELLOW_DAY
    ),
)
def sink_predictions_json(spark, sf):
    path = shared_folder(spark, "predictions")
    made, day = yellow_forecast(spark, sf), DAYS["yellow"][2]
    for one in (day, "2024-01-31", day):
        sinks.save_predictions(made, f"{path}/{VERSION}", "yellow", one)
    stored = sinks.load_predictions(spark, f"{path}/{VERSION}", "yellow", day)
    return stored.select(
        "service",
        F.col("day").cast("date").alias("day"),
        F.col("hour").cast("int").alias("hour"),
        F.col("zone_id").cast("int").alias("zone_id"),
        "zone_name",
        round_half_up(F.col("predicted_pickups"), 6).alias("predicted_pickups"),
    )


# ---- demand from landed files -------------------------------------------------------

LANDINGS = {
    # The last landing also brings rows of the first: those of closed hours are late.
    "landed_trips": "SELECT pickup_datetime, PULocationID, CASE WHEN pickup_datetime < TIMESTAMP '2024-01-11' AND dropoff_datetime > pickup_datetime THEN 1 "
    "WHEN pickup_datetime < TIMESTAMP '2024-01-21' AND dropoff_datetime > pickup_datetime THEN 2 ELSE 3 END AS landing FROM yellow_loaded",
    "closed": "SELECT max(pickup_datetime) - INTERVAL 2 HOUR AS until FROM landed_trips WHERE landing < 3",
    "complete": "SELECT max(pickup_datetime) - INTERVAL 2 HOUR AS until FROM landed_trips",
    "streamed": "SELECT CAST(PULocationID AS INT) AS zone_id, date_trunc('hour', pickup_datetime) AS hour, count(*) AS pickups FROM landed_trips, closed, complete "
    "WHERE date_trunc('hour', pickup_datetime) + INTERVAL 1 HOUR <= complete.until AND (landing < 3 OR date_trunc('hour', pickup_datetime) + INTERVAL 1 HOUR > closed.until) GROUP BY 1, 2",
}


@register(
    "stream_hourly_demand",
    query(
        "SELECT p.zone_id, strftime(p.hour, '%Y-%m-%d %H:%M:%S') AS hour, coalesce(s.pickups, 0) AS pickups FROM full_panel p LEFT JOIN streamed s USING (zone_id, hour)",
        {**FULL, **LANDINGS},
    ),
)
def stream_hourly_demand(spark, sf):
    """Three landings of raw trip files, each followed by one incremental update."""
    root = shared_folder(spark, "stream")
    raw = inputs.yellow_raw(spark, sf)
    start = F.col("tpep_pickup_datetime")
    usual = F.col("tpep_dropoff_datetime") > start
    first, second = (F.coalesce((start < F.lit(day).cast("timestamp_ntz")) & usual, F.lit(False)) for day in ("2024-01-11", "2024-01-21"))
    for part in (first, ~first & second, ~first & ~second):
        raw.where(part).write.mode("append").parquet(f"{root}/trips")
        demand.update_demand(spark, f"{root}/trips", YELLOW, f"{root}/hours", f"{root}/progress")
    return ts_text(demand.panel_of(spark, f"{root}/hours", inputs.zones(spark, sf), START, END), "hour")
