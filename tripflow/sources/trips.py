"""Trip record scans."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tripflow import schemas
from tripflow.config import FHVHV, GREEN, YELLOW, Service

SCHEMAS = {"yellow": schemas.YELLOW_RAW, "green": schemas.GREEN_RAW, "fhvhv": schemas.FHVHV_RAW}


def load_trips(spark: SparkSession, path: str | list[str], service: Service) -> DataFrame:
    """Fixed-schema scan of one service, with the timestamps under their common names."""
    raw = spark.read.schema(SCHEMAS[service.name]).parquet(*([path] if isinstance(path, str) else path))
    return raw.withColumnsRenamed(service.renames)


def typed_trips(raw: DataFrame, service: Service) -> DataFrame:
    """Raw trips of a table as ``load_trips`` returns those of files: columns and types of the schema, common timestamps."""
    columns = [F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(SCHEMAS[service.name])]
    return raw.select(*columns).withColumnsRenamed(service.renames)


def load_yellow(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return load_trips(spark, path, YELLOW)


def load_green(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return load_trips(spark, path, GREEN)


def load_fhvhv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return load_trips(spark, path, FHVHV)


def union_drifting(frames: list[DataFrame], types: dict[str, str]) -> DataFrame:
    """Union of monthly files whose columns differ in case, type or presence.

    Names are compared in lower case; ``types`` gives the common type of each
    column to keep. A column missing in a file is null there.
    """
    wanted = {name.lower(): (name, kind) for name, kind in types.items()}
    aligned = []
    for frame in frames:
        present = {c.lower(): c for c in frame.columns}
        aligned.append(
            frame.select(
                *[
                    F.col(f"`{present[low]}`").cast(kind).alias(name)
                    for low, (name, kind) in wanted.items()
                    if low in present
                ]
            )
        )
    result = aligned[0]
    for frame in aligned[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result.select(*types)


def range_filter(
    df: DataFrame,
    start: str,
    end: str,
    ts: str = "pickup_datetime",
    year: str = "pickup_year",
    month: str = "pickup_month",
) -> DataFrame:
    """Rows with start <= ts < end, plus the matching year/month partition filter.

    A filter on the timestamp alone does not prune ``year/month`` folders, so the
    months that the range touches are named as well.
    """
    first = date.fromisoformat(start[:10])
    last = date.fromisoformat(end[:10])
    months = F.col(year) * 12 + F.col(month)
    in_range = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (
        F.col(ts) < F.lit(end).cast("timestamp_ntz")
    )
    pruned = F.col(year).between(first.year, last.year)
    if first.year == last.year:
        pruned = pruned & F.col(month).between(first.month, last.month)
    else:
        pruned = pruned & months.between(
            first.year * 12 + first.month, last.year * 12 + last.month
        )
    return df.where(pruned & in_range)


def clean_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """The three columns of the demand panel for a date range; rows with nulls drop out."""
    return (
        range_filter(df, start, end)
        .select("pickup_datetime", "PULocationID", "DOLocationID")
        .na.drop()
    )


def unify_services(yellow: DataFrame, fhvhv: DataFrame) -> DataFrame:
    """Both services under common names, tagged with their source."""

    def common(df: DataFrame, distance: str, tip: str, source: str) -> DataFrame:
        return df.select(
            F.col("PULocationID").cast("int").alias("PULocationID"),
            "pickup_datetime",
            F.col(distance).alias("trip_miles"),
            F.col("trip_time").cast("bigint").alias("trip_time"),
            "total_amount",
            F.col(tip).alias("tips"),
            "pickup_borough",
            "pickup_zone",
            F.lit(source).alias("source"),
        )

    return common(yellow, "trip_distance", "tip_amount", "yellow").unionByName(
        common(fhvhv, "trip_miles", "tips", "fhvhv")
    )
