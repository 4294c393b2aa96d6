"""Hourly demand kept up to date from trip files as they land (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripflow.config import Service
from tripflow.operators.panel import time_grid
from tripflow.sources.trips import SCHEMAS

#: How long an hour stays open for trips that land late.
DELAY = "2 hours"


def trip_stream(spark: SparkSession, path: str, service: Service) -> DataFrame:
    """New trip files of a folder and its subfolders, as a stream with the service's common column names."""
    files = spark.readStream.schema(SCHEMAS[service.name]).option("recursiveFileLookup", True)
    return files.parquet(path).withColumnsRenamed(service.renames)


def hourly_demand(trips: DataFrame, delay: str = DELAY) -> DataFrame:
    """Pickups per zone and hour; an hour is given out once, when the latest pickup is ``delay`` past its end.

    A trip whose hour has been given out is late and not counted. Rows without time or zone are left out. The state
    holds one count per zone and open hour, whatever the number of trips; a hot zone is a partial aggregate.
    """
    # Watermarks need a timestamp with zone; the session's zone takes it there and back unchanged.
    timed = trips.where(F.col("pickup_datetime").isNotNull() & F.col("PULocationID").isNotNull())
    timed = timed.select(F.col("PULocationID").cast("int").alias("zone_id"), F.col("pickup_datetime").cast("timestamp_ltz").alias("at"))
    counts = timed.withWatermark("at", delay).groupBy(F.window("at", "1 hour"), "zone_id").agg(F.count(F.lit(1)).alias("pickups"))
    return counts.select("zone_id", F.col("window.start").cast("timestamp_ntz").alias("hour"), "pickups")


def update_demand(spark: SparkSession, trips: str, service: Service, target: str, checkpoint: str, delay: str = DELAY) -> None:
    """Count the files that landed since the last call and append the hours that are complete now.

    Progress and open hours are kept at ``checkpoint``, so a call after a lost driver goes on where the last
    one ended and appends no hour twice. All paths lie in a store that every executor reaches.
    """
    stream = hourly_demand(trip_stream(spark, trips, service), delay)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start(target).awaitTermination()


def panel_of(spark: SparkSession, target: str, zones: DataFrame, start: str, end: str) -> DataFrame:
    """The stored hours in [start, end) as a panel: every zone and hour, 0 where none was counted."""
    return time_grid(zones, start, end).join(spark.read.parquet(target), ["zone_id", "hour"], "left").na.fill(0, subset=["pickups"])
