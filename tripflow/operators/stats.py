"""Correlations, regression lines, error metrics and sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.operators.joins import join_dimension


def pearson(x: str, y: str) -> Column:
    """Pearson r over rows with both values; null when one of them does not vary.

    The built-in ``corr`` divides by zero there, which is an error in ANSI mode.
    """
    spread = F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_pop(
        F.when(F.col(x).isNotNull(), F.col(y))
    )
    return F.covar_pop(x, y) / F.when(spread != 0, spread)


def correlation_grid(df: DataFrame, rows: list[str], columns: list[str]) -> DataFrame:
    """Pearson r of every row/column pair as rows of a table, in one pass."""
    pairs = [(a, b) for a in rows for b in columns]
    one_row = df.agg(*[pearson(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"), F.col(f"_r{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one_row.select(F.inline(cells))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlations of all column pairs over rows complete in them."""
    return correlation_grid(df.na.drop(subset=columns), columns, columns)


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r, degree-1 fit, the t statistic of r and its two-sided p-value."""
    n, r = F.col("n"), F.col("r")
    t = r * F.sqrt((n - 2) / F.when(1 - r * r > 0, 1 - r * r))
    return df.agg(
        F.regr_count(F.col(y), F.col(x)).alias("n"),
        pearson(x, y).alias("r"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
    ).withColumns({"t": t, "p_value": correlation_p_value(r, n)})


def correlation_p_value(r: Column, n: Column, steps: int = 20_000) -> Column:
    """Two-sided p-value of a correlation over ``n`` rows; null without r or below three rows.

    The share of the integral of sin(u) ** (n - 3) up to asin(sqrt(1 - r * r)) in that up to a right angle, both
    by Simpson's rule.
    """

    def integral(upper: Column) -> Column:
        def density(i: Column) -> Column:
            return F.pow(F.sin(upper * i / steps), n - 3)

        inner = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps - 1)), F.lit(0.0), lambda total, i: total + F.when(i % 2 == 1, 4.0).otherwise(2.0) * density(i)
        )
        return (density(F.lit(0)) + inner + density(F.lit(steps))) * upper

    upper = F.asin(F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))
    return F.when((n > 2) & r.isNotNull(), integral(upper) / integral(F.lit(math.pi / 2)))


def pearson_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation: a regularised incomplete beta integral.

    Simpson's rule after the substitution u = sin^2 keeps the integrand smooth.
    """
    if n <= 2 or abs(r) >= 1:
        return 0.0 if n > 2 else float("nan")
    a = (n - 2) / 2
    upper = math.asin(math.sqrt(1 - r * r))
    steps = 20_000
    width = upper / steps

    def density(angle: float) -> float:
        return 2 * math.sin(angle) ** (2 * a - 1) if angle > 0 or a > 0.5 else 2.0

    total = density(0.0) + density(upper)
    total += sum((4 if i % 2 else 2) * density(i * width) for i in range(1, steps))
    beta = math.exp(math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5))
    return total * width / 3 / beta


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted", by=()) -> DataFrame:
    """R2, MSE, MAE and RMSE in one aggregate."""
    error = F.col(predicted) - F.col(actual)
    spread = F.var_pop(actual) * F.count(actual)
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(error * error).alias("mse"),
            F.avg(F.abs(error)).alias("mae"),
            F.sum(error * error).alias("_sse"),
            spread.alias("_sst"),
        )
        .withColumns(
            {
                "rmse": F.sqrt("mse"),
                "r2": 1 - F.col("_sse") / F.when(F.col("_sst") != 0, F.col("_sst")),
            }
        )
        .drop("_sse", "_sst")
    )


# ---- sampling ---------------------------------------------------------------

def _digest(key: list[str], seed: int):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def stratified_sample(df: DataFrame, key: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """Every row kept with the same probability, whatever its hour.

    A row is in when the hash of its key falls below the fraction, so the sample needs
    no shuffle and does not change with the partitioning; equal fractions in all hour
    strata make separate strata unnecessary.
    """
    if fraction >= 1:
        return df
    threshold = f"{min(int(fraction * 2**32), 2**32 - 1):08x}"
    return df.where(F.substring(_digest(key, seed), 1, 8) < threshold)


def exact_stratified_sample(
    df: DataFrame, stratum: str, key: list[str], fraction: float, seed: int = 42
) -> DataFrame:
    """Exactly ceil(fraction * n) rows of each stratum: those with the smallest hashes.

    Counts per stratum and hash prefix show up to which prefix whole groups belong to
    the sample. Only the rows of the one prefix at the border are ranked, a 65,536th
    of the stratum, so a stratum with most rows is never sorted in one task.
    """
    hashed = df.withColumn("_hash", _digest(key, seed)).withColumn("_prefix", F.substring("_hash", 1, 4))
    ordered = Window.partitionBy(stratum).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    border = (
        hashed.groupBy(stratum, "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns(
            {
                "_upto": F.sum("_n").over(ordered),
                "_wanted": F.ceil(F.sum("_n").over(Window.partitionBy(stratum)) * F.lit(fraction)),
            }
        )
        .where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
        .select(
            stratum,
            F.col("_prefix").alias("_border"),
            (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_rest"),
        )
    )
    candidates = join_dimension(hashed, border, [stratum], how="inner").where(
        F.col("_prefix") <= F.col("_border")
    )
    whole = candidates.where(F.col("_prefix") < F.col("_border"))
    rank = F.row_number().over(Window.partitionBy(stratum, "_prefix").orderBy("_hash", *key))
    partial = (
        candidates.where(F.col("_prefix") == F.col("_border"))
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= F.col("_rest"))
        .drop("_rank")
    )
    return whole.unionByName(partial).select(*df.columns)
