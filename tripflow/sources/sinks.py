"""Sinks: partitioned trip tables, result tables, prediction and GeoJSON files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tripflow.session import shared_folder


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever store its path names; whether there was one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def land(df: DataFrame, purpose: str, written: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage.

    With ``written``, the paths of earlier steps, those steps are deleted once this one is complete.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    if written is not None:
        while written:
            delete_folder(spark, written.pop())
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def save_trips(
    df: DataFrame,
    path: str,
    columns: list[str] | None = None,
    partitions: tuple[str, ...] = ("pickup_year", "pickup_month"),
) -> None:
    """Snappy parquet by year and month; a rerun replaces only the months it writes.

    The rebalance hint gathers the rows of a month into files of the advisory size
    and splits a month that holds most rows over many tasks.
    """
    data = df.select(*columns) if columns else df
    (
        data.hint("rebalance", *[F.col(c) for c in partitions])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*partitions)
        .parquet(path)
    )


def replace_months(
    df: DataFrame, path: str, first: tuple[int, int], last: tuple[int, int], partitions: tuple[str, str] = ("pickup_year", "pickup_month")
) -> list[tuple[int, int]]:
    """Make the stored months from ``first`` to ``last`` (year, month) hold exactly the rows of ``df`` in that range.

    Months that came out empty are cleared, others stay untouched. The months written are observed during
    the write, without a second pass. Rows are written before anything is cleared, and both steps give the same
    result when repeated, so a rerun mends whatever a lost driver left. Returns the cleared months.
    """
    year, month = (F.col(c).cast("int") for c in partitions)
    number = year * 12 + month
    low, high = (y * 12 + m for y, m in (first, last))
    seen = Observation("months")
    kept = df.where((number >= low) & (number <= high)).observe(seen, F.collect_set(F.struct(*partitions)).alias("months"))
    save_trips(kept, path, partitions=partitions)
    written = {(row[0], row[1]) for row in seen.get["months"]}
    spark, cleared = df.sparkSession, []
    for at in range(low, high + 1):
        one = ((at - 1) // 12, (at - 1) % 12 + 1)
        if one not in written and delete_folder(spark, f"{path}/{partitions[0]}={one[0]}/{partitions[1]}={one[1]}"):
            cleared.append(one)
    return cleared


def save_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        # Outer blanks are part of the values; the writer would trim them.
        (
            writer.option("header", True)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    else:
        writer.format(fmt).save(path)


def result_table(spark: SparkSession, path: str, compute, reuse: bool = True) -> DataFrame:
    """The stored result at ``path`` if there is one, else compute, store and read it."""
    if reuse:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    save_result(compute(), path)
    return spark.read.parquet(path)


def save_predictions(df: DataFrame, path: str, service: str, day: str) -> None:
    """Dated JSON cache: one folder per service and date, replaced on rerun."""
    (
        df.withColumns({"service": F.lit(service), "day": F.lit(day)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("service", "day")
        .json(path)
    )


def load_predictions(spark: SparkSession, path: str, service: str, day: str) -> DataFrame:
    """Only the folder of that service and date is read."""
    return spark.read.option("basePath", path).json(f"{path}/service={service}/day={day}")


def save_text_lines(df: DataFrame, path: str) -> None:
    """One text column, one JSON document per line."""
    df.write.mode("overwrite").text(path)
