"""Physical plans: pushed filters, pruned columns and folders, bounded broadcasts.

That no plan holds Python operators or joins without keys is checked query by query
in ``test_queries``.
"""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tripflow.operators import joins, quality, rollups
from tripflow.plans import inputs
from tripflow.sources.trips import range_filter

def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = rollups.hourly_demand(inputs.yellow_trips(spark, sf).where(F.col("trip_distance") > 3))
    text = plan(df)
    assert "GreaterThan(trip_distance,3.0)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"trip_distance", "pickup_hour", "pickup_is_weekend"}


def test_cleaning_rules_are_pushed(spark, sf):
    text = plan(quality.clean(inputs.yellow_loaded(spark, sf), inputs.YELLOW_CITY))
    for pushed in ("GreaterThanOrEqual(trip_distance,0.1)", "GreaterThanOrEqual(PULocationID,1)", "LessThanOrEqual(total_amount,200.0)"):
        assert pushed in text


def test_month_range_prunes_folders(spark, sf):
    text = plan(range_filter(inputs.fhvhv_trips(spark, sf), "1997-11-15", "1998-02-10"))
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", text).group(1)
    assert "pickup_year" in filters and "pickup_month" in filters


def test_profiles_read_the_table_once(spark, sf):
    df = quality.profile_nulls(inputs.yellow_loaded(spark, sf))
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert physical.count("FileScan") == 1


def test_zone_joins_broadcast_the_zones(spark, sf):
    text = plan(entry.queries()["join_zones"](spark, sf))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_dimension_joins_run_no_job_and_hint_no_broadcast(spark):
    fact = spark.range(100).withColumn("k", F.col("id") % 10)
    dim = spark.range(50).withColumnRenamed("id", "k").withColumn("v", F.raise_error(F.lit("a job ran")))
    text = plan(joins.join_dimension(fact, dim, ["k"]))
    assert "Join LeftOuter" in text and "strategy=broadcast" not in text
