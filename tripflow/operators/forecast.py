"""Demand forecasts that feed on themselves: a graph autoregression and a loop for any model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tripflow.operators import zone_graph
from tripflow.operators.panel import HORIZONS, INPUT_STEPS
from tripflow.sources.sinks import land

#: Steps of a forecast computed in one job; then the state is written and its lineage ends.
STEPS_PER_JOB = 4


def _hours(count: int) -> Column:
    return F.make_dt_interval(hours=F.lit(count))


# ---- graph autoregression -----------------------------------------------------

@dataclass(frozen=True)
class GraphModel:
    """Deviation from the zone's mean of the hour = own * deviation before + near * that of the neighbours.

    ``profile`` has the means by hour of day of each zone, ``weights`` the neighbours of each zone.
    """

    profile: DataFrame
    weights: DataFrame
    own: float
    near: float


def hour_profile(panel: DataFrame) -> DataFrame:
    """Per zone a map from the hour of day to its mean pickups."""
    means = panel.groupBy("zone_id", F.hour("hour").alias("h")).agg(F.avg("pickups").alias("mean"))
    return means.groupBy("zone_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "mean"))).alias("profile"))


def _mean_at(hour: Column) -> Column:
    return F.coalesce(F.try_element_at("profile", F.hour(hour)), F.lit(0.0))


def fit_graph(train: DataFrame, weights: DataFrame) -> GraphModel:
    """Least squares with two coefficients, from five sums over all zones and hours.

    Without an independent second regressor the neighbours' coefficient is 0, without any deviation both are.
    """
    profile = land(hour_profile(train), "profile")
    deviations = train.join(profile, "zone_id").select("zone_id", "hour", (F.col("pickups") - _mean_at(F.col("hour"))).alias("now"))
    before = deviations.select("zone_id", (F.col("hour") + _hours(1)).alias("hour"), F.col("now").alias("own"))
    rows = deviations.join(zone_graph.neighbour_mean(before, weights, "own", "near", ["hour"]), ["zone_id", "hour"])
    products = [("own", "own"), ("own", "near"), ("near", "near"), ("own", "now"), ("near", "now")]
    sums = rows.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)) for a, b in products]).first()
    oo, on, nn, oy, ny = sums
    determinant = oo * nn - on * on
    if determinant > 1e-9 * oo * nn:
        return GraphModel(profile, weights, (oy * nn - ny * on) / determinant, (ny * oo - oy * on) / determinant)
    return GraphModel(profile, weights, oy / oo if oo else 0.0, 0.0)


def save_graph(model: GraphModel, path: str) -> None:
    model.profile.write.parquet(f"{path}/profile")
    model.weights.write.parquet(f"{path}/weights")
    model.profile.sparkSession.createDataFrame([(model.own, model.near)], "own double, near double").write.parquet(f"{path}/coefficients")


def load_graph(spark: SparkSession, path: str) -> GraphModel:
    own, near = spark.read.parquet(f"{path}/coefficients").first()
    return GraphModel(spark.read.parquet(f"{path}/profile"), spark.read.parquet(f"{path}/weights"), own, near)


def graph_step(model: GraphModel) -> Callable[[DataFrame], DataFrame]:
    """One hour ahead from the last value of each history; never negative."""

    def predict(rows: DataFrame) -> DataFrame:
        keyed = rows.join(model.profile, "zone_id", "left")
        own = F.element_at("history", -1) - _mean_at(F.col("hour") - _hours(1))
        keyed = keyed.withColumns({"_now": _mean_at(F.col("hour")), "_own": own}).drop("profile")
        near = zone_graph.neighbour_mean(keyed, model.weights, "_own", "_near", ["start"])
        value = F.col("_now") + model.own * F.col("_own") + model.near * F.col("_near")
        return near.withColumn("predicted", F.greatest(value, F.lit(0.0))).drop("_now", "_own", "_near")

    return predict


# ---- recursion ----------------------------------------------------------------

def histories(panel: DataFrame, steps: int = INPUT_STEPS, start: str | None = None) -> DataFrame:
    """Per zone and start the ``steps`` values before it; all hours with a full history, or one.

    Columns: start, zone_id, history (latest last).
    """
    window = Window.partitionBy("zone_id").orderBy("hour").rowsBetween(-steps, -1)
    if start is None:
        rows = panel.withColumn("history", F.collect_list(F.col("pickups").cast("double")).over(window))
        return rows.where(F.size("history") == steps).select(F.col("hour").alias("start"), "zone_id", "history")
    first = F.lit(start).cast("timestamp_ntz")
    known = panel.where((F.col("hour") < first) & (F.col("hour") >= first - _hours(steps)))
    ordered = F.array_sort(F.collect_list(F.struct("hour", F.col("pickups").cast("double").alias("v"))))
    return known.groupBy("zone_id").agg(F.transform(ordered, lambda p: p["v"]).alias("history")).select(
        first.alias("start"), "zone_id", "history"
    )


def recursive_forecast(
    starts: DataFrame, future: DataFrame, predict: Callable[[DataFrame], DataFrame], steps: int, per_job: int = STEPS_PER_JOB
) -> DataFrame:
    """``steps`` hours from every start, each prediction being the latest value of the next step.

    ``starts`` as from :func:`histories`; ``future`` has zone_id, hour and what is known of that hour.
    ``predict`` adds ``predicted`` to rows of start, zone_id, hour, history and the known columns. The state is one
    row per start and zone, carries its predictions, and is written after every ``per_job`` steps; older
    states are deleted then. Columns: start, zone_id, step (from 1), hour, predicted; an hour that ``future`` lacks
    ends the forecasts that reach it.
    """
    known = [c for c in future.columns if c not in ("zone_id", "hour")]
    marked = future.withColumn("_known", F.lit(True))
    state = starts.withColumn("path", F.array().cast("array<double>"))
    written: list[str] = []
    for step in range(steps):
        rows = state.withColumn("hour", F.col("start") + _hours(step)).join(marked, ["zone_id", "hour"], "left")
        rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast(future.schema[c].dataType)) for c in known})
        scored = predict(rows).withColumn("predicted", F.when(F.col("_known"), F.col("predicted")))
        latest = F.array(F.coalesce("predicted", F.lit(0.0)))
        state = scored.select(
            "start",
            "zone_id",
            F.concat(F.slice("history", 2, F.greatest(F.size("history") - 1, F.lit(0))), latest).alias("history"),
            F.concat("path", F.array("predicted")).alias("path"),
        )
        if (step + 1) % per_job == 0 or step + 1 == steps:
            state = land(state, "forecast-state", written)
    steps_made = state.select("start", "zone_id", F.posexplode("path").alias("_at", "predicted")).where(F.col("predicted").isNotNull())
    hour = F.col("start") + F.make_dt_interval(hours=F.col("_at"))
    return steps_made.select("start", "zone_id", (F.col("_at") + 1).alias("step"), hour.alias("hour"), "predicted")


def horizon_errors(forecast: DataFrame, actual: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Errors per horizon over the starts whose whole horizon is known.

    Predictions are rounded half to even, after six digits; the cumulative error is the absolute sum of the errors
    of a zone and start. One pass: running sums over the steps of a zone and start serve all horizons.
    """
    found = forecast.join(actual.select("zone_id", "hour", F.col("pickups").alias("_actual")), ["zone_id", "hour"])
    error = F.rint(F.round("predicted", 6)).cast("bigint") - F.col("_actual")
    steps = F.array_sort(F.collect_list(F.struct("step", error.alias("e"))))
    paths = found.groupBy("start", "zone_id").agg(F.transform(steps, lambda s: s["e"]).alias("_errors"))
    cases = F.array(*[F.struct(F.lit(h).alias("horizon"), F.slice("_errors", 1, h).alias("e")) for h in horizons])
    whole = paths.select(F.inline(cases)).where(F.size("e") == F.col("horizon"))

    def total(of):
        return F.aggregate(F.transform("e", of), F.lit(0).cast("bigint"), lambda a, v: a + v)

    windows = F.count(F.lit(1))
    sums = whole.select("horizon", total(lambda d: d * d).alias("_sq"), total(F.abs).alias("_abs"), total(lambda d: d).alias("_sum"))
    return sums.groupBy("horizon").agg(
        windows.alias("windows"),
        (F.sum("_sq") / (windows * F.col("horizon"))).alias("mse"),
        (F.sum("_abs") / (windows * F.col("horizon"))).alias("mae"),
        F.avg(F.abs("_sum")).alias("cumulative_error"),
    )


def day_forecast(model: GraphModel, panel: DataFrame, zones: DataFrame, day: str, steps: int = 24) -> DataFrame:
    """The forecast table of a day: hour (from 0), zone_id, zone_name, borough, predicted_pickups."""
    starts = land(histories(panel, 1, day), "starts")
    hours = starts.select(
        "zone_id", F.explode(F.sequence(F.col("start"), F.col("start") + _hours(steps - 1), _hours(1))).alias("hour")
    )
    made = recursive_forecast(starts, hours, graph_step(model), steps)
    names = zones.select(F.col("LocationID").cast("int").alias("zone_id"), F.col("Zone").alias("zone_name"), F.col("Borough").alias("borough"))
    return made.join(names, "zone_id").select(
        (F.col("step") - 1).alias("hour"), "zone_id", "zone_name", "borough", F.col("predicted").alias("predicted_pickups")
    )
