"""Exact percentiles and modes without sorting all rows of a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.functions.numeric import all_of
from tripflow.sources.sinks import land


def _same(left: str, right: str, columns) -> Column:
    return all_of([F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


#: Numbers of the ranges of infinite values and of NaN, which ranks above all others.
INFINITE, NOT_A_NUMBER = 1 << 60, 1 << 61
#: Parts that a crowded range is cut into, by value.
PARTS = 1000


def _value_range(value: Column, resolution: int) -> Column:
    """Number of the logarithmic range of a value; grows with the value."""
    finite = F.floor(F.log1p(F.abs(value)) * resolution).cast("bigint")
    size = F.when(F.abs(value) == float("inf"), F.lit(INFINITE)).otherwise(finite)
    return F.when(F.isnan(value), F.lit(NOT_A_NUMBER)).otherwise(F.when(value < 0, -size).otherwise(size))


def _hit(ranges: DataFrame, group: list[str], by: str, rank: str, start: Column) -> DataFrame:
    """Of the counted ranges of a group, that in which the rank lies, with the rows before it."""
    running = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    upto = ranges.withColumn("_upto", start + F.sum("_rows").over(running)).withColumn("_before", F.col("_upto") - F.col("_rows"))
    return upto.where((F.col(rank) > F.col("_before")) & (F.col(rank) <= F.col("_upto")))


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    percentiles: dict[str, float],
    resolution: int = 100,
    nearest: bool = False,
    most: int = 10_000,
) -> DataFrame:
    """Exact percentiles per group; each result is a value that occurs.

    One pass collapses the rows to (group, value, count) on the map side and stores that. A percentile's
    range is then narrowed until it holds at most ``most`` distinct values: first to one of at most
    1,420 * ``resolution`` logarithmic ranges, then, as long as that is crowded, to one of ``PARTS`` equal parts between
    its least and greatest value. Only the values of the last range are ordered, so neither a group with a third of all
    rows nor values that lie close together ask more of a task. NaN counts as the largest value.

    The result is the smallest value with at least ``p`` of the rows at or below it,
    or with ``nearest`` the value at the rank next to ``p * (n - 1)``. The stored counts make this run jobs when called.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = land(counted.withColumn("_b", _value_range(F.col("_v").cast("double"), resolution)), "value-counts")
    sizes = [F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_values"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    ranges = counts.groupBy(*keys, "_b").agg(*sizes).withColumn("_all", F.sum("_rows").over(Window.partitionBy(*keys)))
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
            for i, p in enumerate(percentiles.values())
        ]
    )
    rank = (
        F.floor(F.col("_q.p") * (F.col("_all") - 1) + 0.5) + 1
        if nearest
        else F.greatest(F.col("_q.p") * F.col("_all"), F.lit(1.0))
    )
    asked = ranges.withColumn("_q", F.explode(wanted)).withColumns({"_i": F.col("_q.i"), "_rank": rank}).drop("_q", "_all")
    columns = [*keys, "_i", "_rank", "_b", "_before", "_lo", "_hi", "_values"]
    hits = land(_hit(asked, [*keys, "_i"], "_b", "_rank", F.lit(0)).select(columns), "ranges")

    def inside(found: DataFrame) -> DataFrame:
        joined = counts.alias("c").join(found.alias("h"), _same("c", "h", [*keys, "_b"]))
        kept = joined.where((F.col("c._v") >= F.col("h._lo")) & (F.col("c._v") <= F.col("h._hi")))
        return kept.select("c.*", *[F.col(f"h.{c}") for c in ("_i", "_rank", "_before", "_lo", "_hi")])

    while not hits.where(F.col("_values") > most).isEmpty():
        low, high = F.col("_lo").cast("double"), F.col("_hi").cast("double")
        part = F.floor((F.col("_v").cast("double") - low) / (high - low) * PARTS)
        parts = inside(hits.where(F.col("_values") > most)).withColumn("_part", part)
        parts = parts.groupBy(*keys, "_b", "_i", "_rank", F.col("_before").alias("_start"), "_part").agg(*sizes)
        narrower = _hit(parts, [*keys, "_i"], "_part", "_rank", F.col("_start")).select(columns)
        hits = land(hits.where(F.col("_values") <= most).unionByName(narrower), "ranges")

    within = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = inside(hits).withColumn("_cum", F.col("_before") + F.sum("_n").over(within)).where(F.col("_cum") >= F.col("_rank"))
    picks = [
        F.min(F.when(F.col("_i") == i, F.col("_v"))).alias(name)
        for i, name in enumerate(percentiles)
    ]
    return found.groupBy(*keys).agg(*picks) if keys else found.agg(*picks)


def exact_mode(df: DataFrame, value: str) -> DataFrame:
    """Most frequent value; of several the smallest."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias("mode"))
    )


def distance_profile(df: DataFrame, distance: str) -> DataFrame:
    """Minimum, maximum, mean and mode from one pass over the rows.

    The value counts carry all four figures, so the rows are shuffled once, reduced.
    """
    return (
        df.where(F.col(distance).isNotNull())
        .groupBy(F.col(distance).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.max("_v").alias("max_distance"),
            F.min("_v").alias("min_distance"),
            (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("avg_distance"),
            F.min_by(F.col("_v"), F.struct(-F.col("_n"), F.col("_v"))).alias("mode_distance"),
        )
    )


def outlier_fences(df: DataFrame, columns: list[str], low=0.1, high=0.9, reach=1.5) -> DataFrame:
    """Lower and upper fence per column: the two percentiles stretched by their distance."""
    long = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
            )
        )
    )
    cuts = exact_percentiles(long, ["column"], "value", {"q_low": low, "q_high": high}, nearest=True)
    spread = F.col("q_high") - F.col("q_low")
    return cuts.withColumns(
        {"lower": F.col("q_low") - reach * spread, "upper": F.col("q_high") + reach * spread}
    )
