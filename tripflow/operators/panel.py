"""Hourly demand panel: grid, features, windows, baselines and their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.functions.calendar import cyclical_calendar, hour_floor
from tripflow.operators.enrich import weather_by_hour

INPUT_STEPS = 12
HORIZONS = (2, 4, 8, 12, 16, 24)

PANEL_WEATHER = ["temperature_2m", "precipitation", "wind_speed_10m", "relative_humidity_2m"]


def _zone_hours():
    return Window.partitionBy("zone_id").orderBy("hour")


def time_grid(zones: DataFrame, start: str, end: str, id_col: str = "LocationID") -> DataFrame:
    """Every zone with every hour in [start, end).

    Each zone row generates its own hours, which needs no cross join. The zones are
    first spread over a fixed number of tasks: without the number, adaptive execution
    would gather the few zone rows, and with them all hours, in one task.
    """
    tasks = int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hours = F.sequence(
        F.lit(start).cast("timestamp_ntz"),
        F.lit(end).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR"),
        F.expr("INTERVAL 1 HOUR"),
    )
    ids = zones.select(F.col(id_col).cast("int").alias("zone_id")).distinct().repartition(tasks, "zone_id")
    return ids.withColumn("hour", F.explode(hours))


def demand_panel(trips: DataFrame, zones: DataFrame, start: str, end: str, id_col: str = "LocationID") -> DataFrame:
    """Pickups per zone and hour in [start, end), 0 where there were none."""
    ts = F.col("pickup_datetime")
    counts = (
        trips.where((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz")))
        .groupBy(F.col("PULocationID").cast("int").alias("zone_id"), hour_floor("pickup_datetime").alias("hour"))
        .agg(F.count(F.lit(1)).alias("pickups"))
    )
    return time_grid(zones, start, end, id_col).join(counts, ["zone_id", "hour"], "left").na.fill(
        0, subset=["pickups"]
    )


def fill_gaps(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Last known value, else the next known one, else 0, along the hours of a zone.

    A window holds the hours of one zone: some 8,800 rows per year of data.
    """
    before = _zone_hours().rowsBetween(Window.unboundedPreceding, 0)
    # Backwards in time, so that the frame grows row by row instead of being read anew for each.
    after = Window.partitionBy("zone_id").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumns(
        {
            c: F.coalesce(
                F.last(c, ignorenulls=True).over(before),
                F.last(c, ignorenulls=True).over(after),
                F.lit(0.0),
            )
            for c in columns
        }
    )


def feature_panel(
    panel: DataFrame, weather: DataFrame, features: list[str] | None = None
) -> DataFrame:
    """Panel with gap-filled weather and calendar cycles, reduced to the wanted features."""
    hourly = weather_by_hour(weather, PANEL_WEATHER).withColumnsRenamed(
        {"weather_zone": "zone_id", "weather_hour": "hour"}
    )
    full = fill_gaps(panel.join(hourly, ["zone_id", "hour"], "left"), PANEL_WEATHER)
    full = full.withColumns(cyclical_calendar("hour"))
    known = [c for c in full.columns if c not in ("zone_id", "hour")]
    wanted = list(features or known)
    for name in wanted:
        if name not in known:
            raise ValueError(f"Feature '{name}' not found in feature panel.")
    return full.select("zone_id", "hour", *wanted)


def sliding_windows(
    panel: DataFrame, features: list[str], steps: int = INPUT_STEPS, target: str = "pickups"
) -> DataFrame:
    """The ``steps`` previous values of each feature and the value to predict.

    Rows without a full history are left out.
    """
    history = _zone_hours().rowsBetween(-steps, -1)
    windows = {f"{c}_history": F.collect_list(c).over(history) for c in features}
    index = F.row_number().over(_zone_hours())
    return (
        panel.withColumns({**windows, "_index": index})
        .where(F.col("_index") > steps)
        .select("zone_id", "hour", *windows, F.col(target).alias("target"))
    )


# ---- baselines --------------------------------------------------------------

def _after_history(panel: DataFrame, steps: int) -> DataFrame:
    return panel.withColumn("_index", F.row_number().over(_zone_hours())).where(F.col("_index") > steps).drop("_index")


def hour_means(train: DataFrame, steps: int = INPUT_STEPS) -> DataFrame:
    """Mean pickups per zone and hour of day over the hours that can be predicted."""
    return (
        _after_history(train, steps)
        .groupBy("zone_id", F.hour("hour").alias("hour_of_day"))
        .agg(F.avg("pickups").alias("predicted"))
    )


def baseline_hour_mean(train: DataFrame, test: DataFrame, steps: int = INPUT_STEPS) -> DataFrame:
    """Historical mean of the hour of day; 0 for an hour never seen."""
    keyed = _after_history(test, steps).withColumn("hour_of_day", F.hour("hour"))
    return (
        keyed.join(hour_means(train, steps), ["zone_id", "hour_of_day"], "left")
        .withColumn("predicted", F.coalesce("predicted", F.lit(0.0)))
        .select("zone_id", "hour", F.col("pickups").alias("actual"), "predicted")
    )


def baseline_last(test: DataFrame, steps: int = INPUT_STEPS) -> DataFrame:
    """The value of the hour before."""
    lagged = test.withColumn("predicted", F.lag("pickups").over(_zone_hours()).cast("double"))
    return _after_history(lagged, steps).select(
        "zone_id", "hour", F.col("pickups").alias("actual"), "predicted"
    )


def multi_horizon_error(
    train: DataFrame, test: DataFrame, horizons=HORIZONS, steps: int = INPUT_STEPS
) -> DataFrame:
    """Errors of both baselines when each start predicts several hours ahead.

    Feeding a baseline its own output changes nothing: the hour mean depends on the
    clock alone and the last value stays what it was at the start. So the errors of a
    start are a row frame over the following hours, gathered once for the longest
    horizon, and all horizons come from one pass without recursion. Predictions are
    rounded half to even; the cumulative error is the absolute sum of the errors of a
    zone and start.
    """
    y = F.col("pickups")
    ahead = _zone_hours().rowsBetween(0, max(horizons) - 1)
    keyed = test.withColumn("hour_of_day", F.hour("hour")).join(
        hour_means(train, steps), ["zone_id", "hour_of_day"], "left"
    )
    error = F.rint(F.coalesce("predicted", F.lit(0.0))).cast("bigint") - y
    starts = (
        keyed.withColumns({"_error": error, "_index": F.row_number().over(_zone_hours())})
        .withColumns(
            {
                "_errors": F.collect_list("_error").over(ahead),
                "_future": F.collect_list("pickups").over(ahead),
                "_last": F.lag("pickups").over(_zone_hours()),
            }
        )
        .where(F.col("_index") > steps)
        .select("_errors", F.transform("_future", lambda v: F.col("_last") - v).alias("_last_errors"))
    )
    cases = F.array(
        *[
            F.struct(F.lit(model).alias("model"), F.lit(h).alias("horizon"), F.slice(errors, 1, h).alias("e"))
            for model, errors in (("hour_mean", "_errors"), ("last_value", "_last_errors"))
            for h in horizons
        ]
    )

    def total(of) -> Column:
        return F.aggregate(F.transform("e", of), F.lit(0).cast("bigint"), lambda a, v: a + v)

    windows = F.count(F.lit(1))
    return (
        starts.select(F.inline(cases))
        .where(F.size("e") == F.col("horizon"))
        .withColumns({"_sum": total(lambda d: d), "_sq": total(lambda d: d * d), "_abs": total(F.abs)})
        .groupBy("model", "horizon")
        .agg(
            windows.alias("windows"),
            (F.sum("_sq") / (windows * F.col("horizon"))).alias("mse"),
            (F.sum("_abs") / (windows * F.col("horizon"))).alias("mae"),
            F.avg(F.abs("_sum")).alias("cumulative_error"),
        )
    )


# ---- forecast tables --------------------------------------------------------

def forecast_intensity(forecast: DataFrame) -> DataFrame:
    """Prediction relative to the highest zone of the hour, between 0 and 1."""
    highest = F.max("predicted_pickups").over(Window.partitionBy("hour"))
    scale = F.when(highest == 0, 1.0).otherwise(highest)
    value = F.greatest(F.least(F.col("predicted_pickups") / scale, F.lit(1.0)), F.lit(0.0))
    return forecast.withColumn("intensity", value)


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Whole predicted pickups per hour over all zones."""
    return forecast.groupBy("hour").agg(
        F.sum(F.col("predicted_pickups").cast("int").cast("bigint")).alias("total_pickups")
    )
