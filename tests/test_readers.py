"""CSV loaders find columns by name; gap filling and full samples."""

import pytest
from pyspark.sql import functions as F

from tripflow.operators.stats import stratified_sample
from tripflow.sources.reference_data import load_zone_geometry, read_csv


def test_csv_columns_by_name_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "zones.csv"
    path.write_text('extra,geometry,borough,id,zone\n1,"POINT (1 2)","a ""b""\nc",7,z\n')
    (row,) = load_zone_geometry(spark, str(path)).collect()
    assert row.asDict() == {"id": 7, "zone": "z", "borough": 'a "b"\nc', "geometry": "POINT (1 2)"}


def test_files_with_their_own_headers_and_odd_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('BOROUGH,SQFT,PRICE\n1,"1,200",  5 \n2,- 0,-\n3,x,7.5\n')
    (tmp_path / "b c.csv").write_text('PRICE,other,SQFT,BOROUGH\n8,z,"2,000.0",4.0\n,,,\n9,z,30,5.5\n')
    schema = "BOROUGH int, SQFT double, PRICE double"
    got = read_csv(spark, str(tmp_path), schema, rejects="bad").collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([
        (1, 1200.0, 5.0, {}), (2, 0.0, None, {}), (3, None, 7.5, {"SQFT": "x"}),
        (4, 2000.0, 8.0, {}), (None, None, None, {}), (None, 30.0, 9.0, {"BOROUGH": "5.5"}),
    ], key=str)
    assert sorted(map(str, read_csv(spark, str(tmp_path), schema, multiline=False).collect())) == sorted(
        map(str, read_csv(spark, str(tmp_path), schema).collect())
    )
    with pytest.raises(ValueError, match="no column other"):
        read_csv(spark, str(tmp_path), "other string, PRICE double")


def test_a_full_sample_keeps_every_row(spark):
    assert stratified_sample(spark.range(1000), ["id"], 1.0).count() == 1000


def test_a_rerun_clears_months_that_came_out_empty(spark):
    from tripflow.session import shared_folder
    from tripflow.sources.sinks import replace_months, save_trips

    path = shared_folder(spark, "months")
    schema = "pickup_year int, pickup_month int, v int"
    first = spark.createDataFrame([(2023, 12, 1), (2024, 1, 2), (2024, 2, 3), (2024, 3, 4)], schema)
    save_trips(first, path)
    rerun = spark.createDataFrame([(2023, 12, 9), (2024, 2, 8), (2024, 5, 7)], schema)
    for expected in ([(2024, 1)], []):
        assert replace_months(rerun, path, (2023, 12), (2024, 2)) == expected
        assert sorted(map(tuple, spark.read.parquet(path).select("pickup_year", "pickup_month", "v").collect())) == [
            (2023, 12, 9), (2024, 2, 8), (2024, 3, 4)
        ]
    assert replace_months(rerun.limit(0), path, (2024, 2), (2024, 3)) == [(2024, 2), (2024, 3)]
    assert [r.v for r in spark.read.parquet(path).collect()] == [9]


def test_nested_nan_becomes_null(spark):
    from tripflow.functions.text import nans_to_nulls

    nan = float("nan")
    schema = "a array<struct<x: double, s: string>>, m map<string, array<float>>, s struct<d: decimal(5,2), i: int, f: struct<y: double>>, `odd.name` double"
    rows = [([(nan, "t"), (1.0, None), None], {"k": [nan, 2.0], "n": None}, (None, 3, (nan,)), nan), (None, None, None, None), ([], {}, (None, None, None), 1.5)]
    got = nans_to_nulls(spark.createDataFrame(rows, schema))
    assert [f.dataType for f in got.schema] == [f.dataType for f in spark.createDataFrame(rows, schema).schema]
    one, two, three = got.collect()
    assert one.asDict(True) == {"a": [{"x": None, "s": "t"}, {"x": 1.0, "s": None}, None], "m": {"k": [None, 2.0], "n": None}, "s": {"d": None, "i": 3, "f": {"y": None}}, "odd.name": None}
    assert tuple(two) == (None, None, None, None)
    assert three.asDict(True) == {"a": [], "m": {}, "s": {"d": None, "i": None, "f": None}, "odd.name": 1.5}


def test_area_under_the_curve_with_ties_and_one_class(spark):
    from tripflow.operators.scoring import area_under_curve

    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, float("nan")), (None, 0.3), (0, None)]
    table = spark.createDataFrame(rows, "y int, s double")
    pairs = [(p, o) for y, p in rows[:5] if y == 1 for z, o in rows[:5] if z == 0]
    expected = sum(1.0 if p != p or p > o else 0.5 if p == o else 0.0 for p, o in pairs) / len(pairs)
    got = area_under_curve(table, F.col("y") == 1, "s").first()
    assert (got.positives, got.others, got.auc) == (3, 2, expected)
    assert area_under_curve(table.where("y = 1"), F.col("y") == 1, "s").first().auc is None
