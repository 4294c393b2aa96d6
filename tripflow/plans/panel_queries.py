"""Registered panel, baseline and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.functions.calendar import add_pickup_calendar
from tripflow.functions.fares import add_trip_columns
from tripflow.functions.numeric import round_half_up
from tripflow.operators import enrich, lookups, models, panel, quality, scoring, stats
from tripflow.plans import inputs
from tripflow.plans.check_sql import CTES, query, r
from tripflow.plans.place_queries import COUNTED, group_density
from tripflow.plans.registry import register
from tripflow.plans.rollup_queries import rounded
from tripflow.plans.source_queries import ts_text
from tripflow.schemas import WEATHER_VALUES
from tripflow.session import sibling
from tripflow.sources.sinks import land

START, CUT, END = "2024-01-01", "2024-01-21", "2024-01-31"
FEATURES = ["pickups", "precipitation", "wind_speed_10m", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]

# ---- panel ------------------------------------------------------------------


def panel_cte(name, start, end, source="yellow_loaded"):
    return {
        f"{name}_grid": f"SELECT LocationID AS zone_id, unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour FROM zones",
        f"{name}_counts": "SELECT CAST(PULocationID AS INT) AS zone_id, date_trunc('hour', pickup_datetime) AS hour, count(*) AS pickups "
        f"FROM {source} WHERE pickup_datetime >= TIMESTAMP '{start}' AND pickup_datetime < TIMESTAMP '{end}' GROUP BY 1, 2",
        name: f"SELECT zone_id, hour, coalesce(pickups, 0) AS pickups, row_number() OVER (PARTITION BY zone_id ORDER BY hour) AS i FROM {name}_grid LEFT JOIN {name}_counts USING (zone_id, hour)",
    }


FULL = panel_cte("full_panel", START, END)
SPLIT = {**panel_cte("train_panel", START, CUT), **panel_cte("test_panel", CUT, END)}


def make_panel(spark, sf, start=START, end=END, trips=inputs.yellow_loaded):
    return panel.demand_panel(trips(spark, sf), inputs.zones(spark, sf), start, end)


def train_and_test(spark, sf):
    return make_panel(spark, sf, START, CUT), make_panel(spark, sf, CUT, END)


HOUR = "strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour"


@register("demand_panel", query(f"SELECT zone_id, {HOUR}, pickups FROM full_panel", FULL))
def demand_panel(spark, sf):
    return ts_text(make_panel(spark, sf), "hour")


def filled_sql(c):
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY zone_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY zone_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)"
    )


WEATHERED = {**FULL, "panel_weather": "SELECT p.*, w.* EXCLUDE (datetime, id) FROM full_panel p LEFT JOIN weather w ON w.id = p.zone_id AND w.datetime = p.hour"}


@register(
    "panel_fill",
    query(f"SELECT zone_id, {HOUR}, " + ", ".join(f"{r(filled_sql(c), 6)} AS {c}" for c in panel.PANEL_WEATHER) + " FROM panel_weather", WEATHERED),
)
def panel_fill(spark, sf):
    weather = enrich.weather_by_hour(inputs.weather(spark, sf), panel.PANEL_WEATHER).withColumnsRenamed(
        {"weather_zone": "zone_id", "weather_hour": "hour"}
    )
    joined = make_panel(spark, sf).drop("pickups").join(weather, ["zone_id", "hour"], "left")
    return ts_text(rounded(panel.fill_gaps(joined, panel.PANEL_WEATHER), **{c: 6 for c in panel.PANEL_WEATHER}), "hour")


CYCLE_SQL = {
    "hour_sin": "sin(2 * pi() * hour(hour) / 24)", "hour_cos": "cos(2 * pi() * hour(hour) / 24)",
    "dow_sin": "sin(2 * pi() * ((dayofweek(hour) + 6) % 7) / 7)", "dow_cos": "cos(2 * pi() * ((dayofweek(hour) + 6) % 7) / 7)",
}


@register(
    "feature_panel",
    query(
        f"SELECT zone_id, {HOUR}, pickups, {r(filled_sql('precipitation'), 6)} AS precipitation, {r(filled_sql('wind_speed_10m'), 6)} AS wind_speed_10m, "
        + ", ".join(f"{r(e, 6)} AS {n}" for n, e in CYCLE_SQL.items())
        + " FROM panel_weather",
        WEATHERED,
    ),
)
def feature_panel(spark, sf):
    df = panel.feature_panel(make_panel(spark, sf), inputs.weather(spark, sf), FEATURES)
    return ts_text(rounded(df, **{c: 6 for c in FEATURES if c != "pickups"}), "hour")


@register(
    "sliding_windows",
    query(
        f"SELECT zone_id, {HOUR}, history, target FROM (SELECT *, pickups AS target, array_to_string(list(pickups) OVER (PARTITION BY zone_id ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), ',') AS history FROM full_panel) WHERE i > 12",
        FULL,
    ),
)
def sliding_windows(spark, sf):
    windows = panel.sliding_windows(make_panel(spark, sf), ["pickups"])
    joined = windows.withColumn("history", F.array_join(F.col("pickups_history").cast("array<string>"), ","))
    return ts_text(joined, "hour").drop("pickups_history")


# ---- baselines --------------------------------------------------------------

BASELINES = {
    **SPLIT,
    "means": "SELECT zone_id, hour(hour) AS h, avg(pickups) AS predicted FROM train_panel WHERE i > 12 GROUP BY 1, 2",
    "by_mean": "SELECT t.zone_id, t.hour, t.i, t.pickups AS actual, coalesce(predicted, 0) AS predicted FROM test_panel t LEFT JOIN means m ON m.zone_id = t.zone_id AND m.h = hour(t.hour)",
    "by_last": "SELECT zone_id, hour, i, pickups AS actual, CAST(lag(pickups) OVER (PARTITION BY zone_id ORDER BY hour) AS DOUBLE) AS predicted FROM test_panel",
}


@register("baseline_hour_mean", query(f"SELECT zone_id, {HOUR}, actual, {r('predicted', 6)} AS predicted FROM by_mean WHERE i > 12", BASELINES))
def baseline_hour_mean(spark, sf):
    return ts_text(rounded(panel.baseline_hour_mean(*train_and_test(spark, sf)), predicted=6), "hour")


@register("baseline_last", query(f"SELECT zone_id, {HOUR}, actual, predicted FROM by_last WHERE i > 12", BASELINES))
def baseline_last(spark, sf):
    return ts_text(panel.baseline_last(train_and_test(spark, sf)[1]), "hour")


def metrics_sql(name, table):
    return (
        f"SELECT '{name}' AS model, count(*) AS n, {r('avg((predicted - actual) * (predicted - actual))', 6)} AS mse, {r('avg(abs(predicted - actual))', 6)} AS mae, "
        f"{r('sqrt(avg((predicted - actual) * (predicted - actual)))', 6)} AS rmse, {r('(1 - sum((predicted - actual) * (predicted - actual)) / (var_pop(actual) * count(*)))', 6)} AS r2 FROM {table} WHERE i > 12"
    )


@register("regression_metrics", query(metrics_sql("hour_mean", "by_mean") + " UNION ALL " + metrics_sql("last_value", "by_last"), BASELINES))
def regression_metrics(spark, sf):
    train, test = train_and_test(spark, sf)
    both = panel.baseline_hour_mean(train, test).withColumn("model", F.lit("hour_mean")).unionByName(
        panel.baseline_last(test).withColumn("model", F.lit("last_value"))
    )
    return rounded(stats.regression_metrics(both, by=["model"]), mse=6, mae=6, rmse=6, r2=6)


HORIZON_ERRORS = {
    **BASELINES,
    "horizons": f"SELECT unnest([{', '.join(map(str, panel.HORIZONS))}]) AS h",
    "starts": "SELECT s.zone_id, s.i, h, l.predicted AS last FROM test_panel s JOIN by_last l ON l.zone_id = s.zone_id AND l.i = s.i, horizons WHERE s.i > 12 AND s.i + h - 1 <= (SELECT max(i) FROM test_panel)",
    "steps": "SELECT s.zone_id, s.i, s.h, sum(round_even(m.predicted, 0) - m.actual) AS mean_sum, sum(pow(round_even(m.predicted, 0) - m.actual, 2)) AS mean_sq, sum(abs(round_even(m.predicted, 0) - m.actual)) AS mean_abs, "
    "sum(last - m.actual) AS last_sum, sum(pow(last - m.actual, 2)) AS last_sq, sum(abs(last - m.actual)) AS last_abs "
    "FROM starts s JOIN by_mean m ON m.zone_id = s.zone_id AND m.i >= s.i AND m.i < s.i + s.h GROUP BY 1, 2, 3",
}


@register(
    "multi_horizon_error",
    query(
        " UNION ALL ".join(
            f"SELECT '{name}' AS model, CAST(h AS INT) AS horizon, count(*) AS windows, {r(f'sum({p}_sq) / (count(*) * h)', 6)} AS mse, {r(f'sum({p}_abs) / (count(*) * h)', 6)} AS mae, {r(f'avg(abs({p}_sum))', 6)} AS cumulative_error FROM steps GROUP BY h"
            for name, p in (("hour_mean", "mean"), ("last_value", "last"))
        ),
        HORIZON_ERRORS,
    ),
)
def multi_horizon_error(spark, sf):
    df = panel.multi_horizon_error(*train_and_test(spark, sf))
    return rounded(df, mse=6, mae=6, cumulative_error=6)


# ---- models -----------------------------------------------------------------

POI_FEATURES = ["education_per_mi2", "entertainment_per_mi2", "food_drink_per_mi2"]


def joined_pois(spark, sf):
    pois = group_density(spark, sf).select("id", *POI_FEATURES)
    return enrich.join_pois(inputs.yellow_trips(spark, sf), pois, POI_FEATURES)


@register(
    "join_pois",
    query(
        "SELECT PULocationID, DOLocationID, "
        + ", ".join(f"{a}.{c} AS {p}_poi_{c}" for p, a in (("pu", "pd"), ("do", "dd")) for c in POI_FEATURES)
        + ", count(*) AS trips FROM yellow_trips LEFT JOIN densities pd ON pd.id = PULocationID LEFT JOIN densities dd ON dd.id = DOLocationID GROUP BY ALL",
        COUNTED,
    ),
)
def join_pois(spark, sf):
    columns = [f"{p}_poi_{c}" for p in ("pu", "do") for c in POI_FEATURES]
    return joined_pois(spark, sf).groupBy("PULocationID", "DOLocationID", *columns).agg(F.count(F.lit(1)).alias("trips"))


def model_trips(spark, sf, service):
    """Trips with the POI and weather columns of the service's tip model, stored once for the model queries."""
    trips, weather = {"yellow": (inputs.yellow_trips, inputs.weather), "fhvhv": (inputs.fhvhv_trips, inputs.fhvhv_weather)}[service]

    def write(path):
        pois = group_density(spark, sf).select("id", *models.POI_FEATURES)
        joined = enrich.join_pois(trips(spark, sf), pois, models.POI_FEATURES)
        enrich.join_weather(joined, weather(spark, sf), list(WEATHER_VALUES)).write.parquet(path)

    return inputs.landed(spark, sf, f"model_trips_{service}", write)


#: Lines up to which the two-stage model takes the landed rides, as the trees of a small table depend on the order of its rows.
LANDED_LINES = 1_000_000

RIDE_COLUMNS = ["pickup_datetime", "PULocationID", "DOLocationID", "trip_miles", "total_amount", "tip_category"]
TWO_STAGE_COLUMNS = ["pickup_datetime", "tip_category", *models.TIP_FEATURES["fhvhv"]["numeric"], *models.TIP_FEATURES["fhvhv"]["categorical"]]


def two_stage_path(spark, sf):
    """Where the columns of the two-stage model lie, derived without landed rides, in files of as many rows as a task of a fit holds.

    Rides meet their weather with six columns; zones, places and calendar follow behind that shuffle. The dimensions are
    written first, so that their size decides how rides meet them. Shuffle files go once their table is written.
    """

    def write(path):
        tidy = sibling(spark, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})
        zones = land(inputs.zones(tidy, sf), "dimension")
        pois = land(group_density(tidy, sf).select("id", *models.POI_FEATURES), "dimension")
        clean = quality.clean(inputs.fhvhv_records(tidy, sf), inputs.FHVHV_CITY)
        rides = add_trip_columns(clean, inputs.FHVHV_CITY).select(RIDE_COLUMNS)
        (
            enrich.join_weather(rides, inputs.fhvhv_weather(tidy, sf), list(WEATHER_VALUES))
            .transform(enrich.join_zones, zones)
            .transform(add_pickup_calendar)
            .transform(enrich.join_pois, pois, models.POI_FEATURES)
            .select(TWO_STAGE_COLUMNS)
            .write.option("maxRecordsPerFile", models.ROWS_PER_TASK)
            .parquet(path)
        )

    inputs.landed(spark, sf, "two_stage_trips", write)
    return inputs.landed_path(spark, sf, "two_stage_trips", write)


def two_stage_split(spark, sf):
    """Training and test trips of the two-stage model, and whether the training trips are dealt over tasks by their number.

    A file that costs as much to open as a task may read is a task of its own.
    """
    if inputs.table(spark, sf, "lineitem").count() <= LANDED_LINES:
        return *tip_split(spark, sf, "fhvhv"), False
    path = two_stage_path(spark, sf)
    by_file = sibling(spark, **{"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes")})
    train, _ = quality.time_split(by_file.read.parquet(path), SPLIT_DAYS["fhvhv"])
    _, test = quality.time_split(spark.read.parquet(path), SPLIT_DAYS["fhvhv"])
    return train, test, True


#: Version of the stored models.
MODEL_VERSION = "1"


def fitted(spark, sf, name, fit):
    """The stored model of that name, fitted and written on first use; every query reads it from its files."""
    path = inputs.landed_path(spark, sf, f"model_{name}", lambda p: models.save_model(fit(), p, MODEL_VERSION))
    return models.load_model(path, MODEL_VERSION)


SPLIT_DAYS = {"yellow": "2024-01-22", "fhvhv": "2000-01-01"}


def tip_split(spark, sf, service="yellow"):
    return quality.time_split(model_trips(spark, sf, service), SPLIT_DAYS[service])


def tip_model(spark, sf):
    return fitted(spark, sf, "tips", lambda: models.fit_tip_classifier(tip_split(spark, sf)[0], **models.TIP_FEATURES["yellow"]))


MODEL_TRIPS = {
    **COUNTED,
    "model_trips": "SELECT t.*, w.* EXCLUDE (id, datetime), "
    + ", ".join(f"d.{c} AS pu_poi_{c}" for c in models.POI_FEATURES)
    + " FROM yellow_trips t JOIN weather w ON w.id = t.PULocationID AND w.datetime = date_trunc('hour', pickup_datetime) LEFT JOIN densities d ON d.id = t.PULocationID WHERE w.rain IS NOT NULL",
    "model_train": "SELECT * FROM model_trips WHERE pickup_datetime < TIMESTAMP '2024-01-22'",
    "model_test": "SELECT * FROM model_trips WHERE pickup_datetime >= TIMESTAMP '2024-01-22'",
}


@register(
    "tip_features",
    query(
        " UNION ALL ".join(
            [f"SELECT '{c}' AS feature, {r(f'sum({c})', 3)} AS total FROM model_test" for c in models.TIP_FEATURES["yellow"]["numeric"]]
            + [
                f"SELECT '{c}=' || label AS feature, (SELECT CAST(count(*) AS DOUBLE) FROM model_test WHERE CAST({c} AS VARCHAR) = label) AS total FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS label FROM model_train)"
                for c in models.TIP_FEATURES["yellow"]["categorical"]
            ]
        ),
        MODEL_TRIPS,
    ),
)
def tip_features(spark, sf):
    columns = models.TIP_FEATURES["yellow"]
    train, test = tip_split(spark, sf)
    model = fitted(spark, sf, "features", lambda: models.fit_features(train, **columns))
    return rounded(models.feature_totals(model, test, **columns), total=3)


@register("tip_classifier")
def tip_classifier(spark, sf):
    scored = models.score_tips(tip_model(spark, sf), tip_split(spark, sf)[1])
    accuracy = scoring.top_n_accuracy(scored, "tip_category", lookups.PROBABILITIES)
    loss = scoring.log_loss(scored, "tip_category", lookups.PROBABILITIES)
    auc = scoring.area_under_curve(scored.withColumn("_tipped", 1 - F.col("prob_class_0")), F.col("tip_category") > 0, "_tipped")
    return accuracy.withColumns({c: table.select(c).scalar() for table, c in ((loss, "rows"), (loss, "log_loss"), (auc, "auc"))})


@register("score_day")
def score_day(spark, sf):
    scores = models.score_day(tip_model(spark, sf), model_trips(spark, sf, "yellow"), "2024-01-25")
    return lookups.expected_tip_by_zone(scores, inputs.zones(spark, sf))


@register("tip_two_stage")
def tip_two_stage(spark, sf):
    """App-based rides: a tip at all, then its class, from weather, places at both ends, fare and zones."""
    train, test, dealt = two_stage_split(spark, sf)
    columns = models.TIP_FEATURES["fhvhv"]
    binary = fitted(spark, sf, "has_tip", lambda: models.fit_has_tip(train, dealt=dealt, **columns))
    classes = fitted(spark, sf, "tip_class", lambda: models.fit_tip_class(train, dealt=dealt, **columns))
    scored = models.score_two_stage(binary, classes, test)
    auc = scoring.area_under_curve(scored, F.col("tip_category") > 0, "prob_has_tip")
    return models.two_stage_accuracy(scored).withColumn("auc", auc.select("auc").scalar())


@register("event_clusters")
def event_clusters(spark, sf):
    clustered = models.event_clusters(inputs.incidents(spark, sf))
    return clustered.groupBy("cluster", "event_bucket").agg(F.count(F.lit(1)).alias("events"))
