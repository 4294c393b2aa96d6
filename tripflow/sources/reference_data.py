"""Scans of the zone, weather, POI, sales, event and camera files."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, IntegralType, NumericType, StringType, StructField, StructType

from tripflow import schemas
from tripflow.functions.calendar import utc_to_local


def load_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone lookup from CSV with a header, cast to its types."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.col("LocationID").cast("int").alias("LocationID"), "Borough", "Zone", "service_zone"
    )


def load_weather(
    spark: SparkSession, path: str, local_zone: str | None = "America/New_York"
) -> DataFrame:
    """Hourly weather of all zones in one scan.

    Files lie in one folder per zone, named ``7`` or ``id=7``. The stored
    hours are UTC and become wall-clock hours of ``local_zone`` (None keeps UTC).
    """
    raw = (
        spark.read.schema(schemas.WEATHER_RAW)
        .option("recursiveFileLookup", True)
        .parquet(path)
        .withColumn("id", F.regexp_extract(F.col("_metadata.file_path"), "/(?:id=)?(\\d+)/[^/]+$", 1).cast("int"))
    )
    return weather_columns(raw, local_zone)


def weather_columns(raw: DataFrame, local_zone: str | None = "America/New_York") -> DataFrame:
    if local_zone:
        raw = raw.withColumn("datetime", utc_to_local("datetime", local_zone))
    return raw.withColumns(
        {
            "year": F.year("datetime"),
            "month": F.month("datetime"),
            "day": F.dayofmonth("datetime"),
            "hour": F.hour("datetime"),
        }
    )


def load_pois(spark: SparkSession, path: str) -> DataFrame:
    """POI files; the type is the file name ``tag_value.parquet`` or the folder ``poi_type=tag_value``."""
    raw = (
        spark.read.schema(schemas.POI_RAW)
        .option("recursiveFileLookup", True)
        .parquet(path)
    )
    location = F.col("_metadata.file_path")
    name = F.regexp_extract(location, "/(?:poi_type=)?([a-z]+_[a-z_]+)(?:\\.parquet)?(?:/[^/]*)?$", 1)
    return raw.withColumn("poi_type", name).withColumns(
        {
            "main_category": F.split_part("poi_type", F.lit("_"), F.lit(1)),
            "sub_category": F.element_at(F.split("poi_type", "_", 2), 2),
        }
    )


def flatten_poi_elements(elements: DataFrame, category: str) -> DataFrame:
    """Map elements to POI rows: nodes carry their position, other kinds their centre.

    Elements without a position are left out.
    """
    node = F.col("type") == "node"
    return elements.select(
        F.lit(category).alias("category"),
        F.col("id").alias("osm_id"),
        "type",
        F.when(node, F.col("lat")).otherwise(F.col("center.lat")).alias("lat"),
        F.when(node, F.col("lon")).otherwise(F.col("center.lon")).alias("lon"),
        F.try_element_at("tags", F.lit("name")).alias("name"),
        "tags",
    ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def load_poi_elements(spark: SparkSession, path: str, category: str) -> DataFrame:
    return flatten_poi_elements(spark.read.schema(schemas.POI_ELEMENT).json(path), category)


#: What the files write for no value.
NO_VALUE = ("", "-")


def _parsed(raw: Column, kind: DataType) -> Column:
    """A text as a value of its type, null where it does not parse. Numbers may hold blanks and thousands separators."""
    if isinstance(kind, NumericType):
        raw = F.regexp_replace(raw, "[\\s,]", "")
        if isinstance(kind, IntegralType):
            # Whole numbers are also written as 12.0.
            raw = F.regexp_replace(raw, "\\.0*$", "")
    return raw.try_cast(kind) if not isinstance(kind, StringType) else raw


def csv_headers(spark: SparkSession, path: str, multiline: bool = True) -> dict[tuple[str, ...], list[str]]:
    """Files by their header. Runs one small read per file, of its first record."""
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    headers: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(spark.read.text(path).inputFiles()):
        headers.setdefault(tuple(reader.csv(unquote(file)).columns), []).append(unquote(file))
    return headers


def read_csv(spark: SparkSession, path: str, schema: str, rejects: str | None = None, multiline: bool = True) -> DataFrame:
    """The schema's columns of the CSV files at ``path``, found by each file's own header in any order.

    Other columns are left out, a missing one is an error. A value that does not parse becomes null; ``rejects`` names
    a column that maps the columns of such values to their texts. Quoted fields may hold doubled quotes and,
    with ``multiline``, line breaks: then each file is one task; without it large files are split.
    """
    fields = StructType.fromDDL(schema).fields
    parts = []
    for header, files in csv_headers(spark, path, multiline).items():
        missing = [field.name for field in fields if field.name not in header]
        if missing:
            raise ValueError(f"{files[0]} has no column {', '.join(missing)}")
        # Names by position, as the reader would rename repeated ones.
        raw = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        raw = raw.schema(StructType([StructField(f"_{i}", StringType()) for i in range(len(header))])).option("enforceSchema", True).csv(files)
        texts = {field.name: F.col(f"_{header.index(field.name)}") for field in fields}
        columns = [_parsed(texts[field.name], field.dataType).alias(field.name) for field in fields]
        if rejects:
            bad = [
                F.when(
                    _parsed(text, field.dataType).isNull() & text.isNotNull() & ~F.regexp_replace(text, "\\s", "").isin(*NO_VALUE),
                    F.struct(F.lit(field.name).alias("key"), text.alias("value")),
                )
                for field in fields
                for text in (texts[field.name],)
            ]
            columns.append(F.map_from_entries(F.array_compact(F.array(*bad))).alias(rejects))
        parts.append(raw.select(*columns))
    if not parts:
        raise ValueError(f"no files at {path}")
    return reduce(DataFrame.unionByName, parts)


def load_sales(spark: SparkSession, path: str, rejects: str | None = None) -> DataFrame:
    """Property sales from CSV with an explicit schema (no inference pass)."""
    return read_csv(spark, path, schemas.SALES, rejects)


def load_incident_history(spark: SparkSession, path: str, rejects: str | None = None) -> DataFrame:
    """Traffic event history from CSV with an explicit schema."""
    return read_csv(spark, path, schemas.INCIDENT_HISTORY, rejects)


def load_event_feed(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Landed event feed rows. Landed JSON arrays need ``multiline``."""
    return spark.read.schema(schemas.EVENT_FEED).option("multiLine", multiline).json(path)


def load_camera_feed(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schemas.CAMERA_FEED).option("multiLine", multiline).json(path)


def load_zone_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Zone outlines as text (WKT) from CSV."""
    return read_csv(spark, path, schemas.ZONE_GEOMETRY)


def zone_dimension(df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """One row per zone id, whatever its number; a null id is no zone.

    Of several rows for an id the smallest counts. Nothing bounds the number of ids, so joins with
    the result carry no broadcast hint: Spark chooses by the size it finds.
    """
    picked = F.min(F.struct(*[F.col(c) for c in columns])).alias("_v")
    return (
        df.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(picked)
        .select(id_col, "_v.*")
    )
