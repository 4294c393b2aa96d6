"""What a query moves, and over how many tasks, does not hang on the size of the files it reads."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tripflow.config import FHVHV
from tripflow.operators import models, spatial
from tripflow.plans import inputs, panel_queries
from tripflow.session import sibling
from tripflow.sources.trips import load_fhvhv, typed_trips


def rows_of(df):
    return Counter(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three orders, five lines, one of them without its order, and two events."""
    path = str(tmp_path_factory.mktemp("tables"))
    day = datetime(1997, 3, 4)
    kinds = {
        "region": ("r_regionkey int, r_name string", [(0, "ASIA")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(i, f"NATION_{i}", 0) for i in range(25)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz",
                   [(i, 5 + i, "F", 1000.0 * i, day) for i in (1, 2, 3)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
                     [(o, 40 + o, 7 + n, n, 3.0 + n, 8000.0 + o, 0.05, 0.02, "A", "F") for o, n in ((1, 1), (1, 1), (2, 1), (3, 7), (9, 1))] + [(None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, None, None)]),
        "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
                   [(i, datetime(2024, 1, 5, i), 4 + i, "x", 20.0 + i, None) for i in (1, 2)]),
    }
    for name, (schema, rows) in kinds.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def test_records_of_a_table_are_those_of_its_files(spark, tables, tmp_path):
    raw = inputs.fhvhv_raw(spark, tables)
    raw.write.parquet(f"{tmp_path}/raw")
    read, typed = load_fhvhv(spark, f"{tmp_path}/raw"), typed_trips(raw, FHVHV)
    assert typed.columns == read.columns and [f.dataType for f in typed.schema] == [f.dataType for f in read.schema]
    assert rows_of(typed) == rows_of(read) and read.count() == 4


def test_derived_rides_are_the_landed_ones(spark, tables):
    assert inputs.fhvhv_rides(spark, tables).count() > 0
    assert rows_of(inputs.fhvhv_rides(spark, tables)) == rows_of(inputs.fhvhv_trips(spark, tables))


@pytest.mark.parametrize("name", ["market_share", "distance_quantiles", "union_services", "clean_rejects", "trip_durations", "zone_demand_by_service", "sink_result_table"])
def test_rides_are_not_moved_with_all_their_columns(spark, tables, name, monkeypatch):
    monkeypatch.setattr(inputs, "_LANDED", {})
    entry.queries()[name](spark, tables).collect()
    assert not {key[2] for key in inputs._LANDED} & {"fhvhv", "fhvhv_raw"}


def test_many_outlines_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ZONES_PER_TASK", 3)
    x = F.col("id").cast("string")
    square = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", F.col("id") + a, F.lit(b)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]), F.lit("))"))
    zones = spark.range(0, 40, 1, 1).select("id", x.alias("name"), square.alias("geometry"))
    edges = spatial.zone_edges(zones)
    assert edges.rdd.getNumPartitions() >= 14 and edges.count() == 160
    assert spatial.grid_cells(zones).rdd.getNumPartitions() >= 14
    assert spatial.dissolve(edges.withColumn("all", F.lit(1)), "all").count() == 82
    points = spark.range(40).select(F.col("id").alias("p"), (F.col("id") + 0.5).alias("x"), F.lit(0.5).alias("y"))
    assert {(r.p, r.id) for r in spatial.within(points, zones, "x", "y").collect()} == {(i, i) for i in range(40)}


def test_vectors_of_a_fit_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    seen = []

    class Trees:
        def getLabelCol(self):
            return "label"

        def fit(self, vectors):
            seen.append((vectors.rdd.getNumPartitions(), vectors.count()))
            return models.VectorAssembler(inputCols=["n"], outputCol="again")

    train = spark.range(0, 200, 1, 1).select((F.col("id") % 2).cast("double").alias("label"), F.col("id").cast("double").alias("n"), (F.col("id") % 3).cast("string").alias("c"))
    for most in (200, 10):
        monkeypatch.setattr(models, "ROWS_PER_TASK", most)
        models.fit_on_features(train, Trees(), numeric=["n"], categorical=["c"])
    assert seen == [(1, 200), (20, 200)]


def test_vectors_of_a_dealt_table_stay_in_their_tasks(spark, monkeypatch):
    seen = []

    class Trees:
        def getLabelCol(self):
            return "label"

        def fit(self, vectors):
            seen.append((vectors.rdd.getNumPartitions(), "RoundRobin" in vectors._jdf.queryExecution().toString()))
            return models.VectorAssembler(inputCols=["n"], outputCol="again")

    train = spark.range(0, 200, 1, 20).select(F.lit(1.0).alias("label"), F.col("id").cast("double").alias("n"), (F.col("id") % 3).cast("string").alias("c"))
    monkeypatch.setattr(models, "ROWS_PER_TASK", 10)
    models.fit_on_features(train, Trees(), dealt=True, numeric=["n"], categorical=["c"])
    assert seen == [(20, False)]


def test_a_sibling_session_has_the_settings_of_the_first(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        other = sibling(spark, **{"spark.sql.files.openCostInBytes": "7"})
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [other.conf.get(f"spark.sql.{k}") for k in ("session.timeZone", "shuffle.partitions", "files.openCostInBytes")] == ["Asia/Tokyo", "8", "7"]
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC" and spark.conf.get("spark.sql.files.openCostInBytes") != "7"
    assert other.sparkContext.applicationId == spark.sparkContext.applicationId


@pytest.fixture(scope="module")
def rides(spark, tables, tmp_path_factory):
    """600 lines of 300 orders on both sides of the split day, with repeated and null keys and values."""
    path = str(tmp_path_factory.mktemp("rides"))
    for name in ("region", "nation"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    i = F.col("id")
    day = F.expr("timestamp_ntz'1999-12-20 00:00:00'") + F.make_dt_interval((i % 25).cast("int"))
    orders = spark.range(300).select(
        F.when(i != 299, i).alias("o_orderkey"), F.when(i % 50 != 0, i % 40).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        (i * 10.0).alias("o_totalprice"), F.when(i % 60 != 1, day).alias("o_orderdate"),
    )
    orders.union(orders.where("o_orderkey = 7")).write.parquet(f"{path}/orders.parquet")
    lines = spark.range(600).select(
        F.when(i % 90 != 0, i % 302).alias("l_orderkey"), (i * 7 % 400).alias("l_partkey"), (i % 33).alias("l_suppkey"), (i % 7 + 1).cast("int").alias("l_linenumber"),
        F.when(i % 70 == 0, F.lit(float("nan"))).when(i % 80 != 0, i % 30 + 1.5).alias("l_quantity"), (8000 + i * 11.0).alias("l_extendedprice"),
        (i % 6 / 100.0).alias("l_discount"), F.lit(0.02).alias("l_tax"), F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
    )
    lines.union(lines.where("l_partkey < 40")).write.parquet(f"{path}/lineitem.parquet")
    spark.range(200).select(i.alias("p_partkey"), F.lit("x").alias("p_name")).write.parquet(f"{path}/part.parquet")
    return path


def test_trips_of_a_large_two_stage_model_are_those_of_a_small_one(spark, rides, monkeypatch):
    small = [rows_of(x.select(panel_queries.TWO_STAGE_COLUMNS)) for x in panel_queries.two_stage_split(spark, rides)[:2]]
    assert all(sum(x.values()) > 30 and max(x.values()) > 1 for x in small)
    monkeypatch.setattr(panel_queries, "LANDED_LINES", 0)
    monkeypatch.setattr(models, "ROWS_PER_TASK", 9)
    *large, dealt = panel_queries.two_stage_split(spark, rides)
    assert [rows_of(x) for x in large] == small and dealt
    assert large[0].groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 9


def test_a_large_two_stage_model_lands_no_rides(spark, rides, monkeypatch):
    monkeypatch.setattr(panel_queries, "LANDED_LINES", 0, raising=False)
    monkeypatch.setattr(inputs, "_LANDED", {})
    rows = entry.queries()["tip_two_stage"](spark, rides).collect()
    assert len(rows) == 3 and rows[0].auc is not None
    assert not {key[2] for key in inputs._LANDED} & {"fhvhv", "fhvhv_raw", "model_trips_fhvhv"}
