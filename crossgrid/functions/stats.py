"""Statistics over dates and names that neither Spark nor its NaN rules give as they are needed."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ops import average_rank


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null without variance, where corr() would fail."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def rank_scale(x: Column, *keys: str) -> Column:
    """Average-tie ranks mapped to [-1, 1]; 0 where a group has one value. Values that agree to twelve decimals tie."""
    x = F.round(x, 12)
    n = F.count(x).over(Window.partitionBy(*keys))
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.try_divide(2.0 * (average_rank(x, *keys) - 1), (n - 1).cast("double")) - 1.0)


def daily_ic(rows: DataFrame, x: str, y: str, spearman: bool = True, least: int = 0, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """keys and ic: the correlation over names where both are known; days of fewer than ``least`` names or without variance go."""
    rows = rows.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    if spearman:
        rows = rows.withColumns({"_x": average_rank(F.col("_x"), *keys), "_y": average_rank(F.col("_y"), *keys)})
    return rows.groupBy(*keys).agg(safe_corr(F.col("_x"), F.col("_y")).alias("ic"), F.count("*").alias("_n")).where((F.col("_n") >= least) & F.col("ic").isNotNull()).drop("_n")


def ic_summary(ics: DataFrame, *keys: str) -> DataFrame:
    """mean_ic, sd_ic, icir, t_stat, n_days, sign (-1 where the mean isn't positive)."""
    return ics.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"), F.count("ic").alias("n_days")).withColumns(
        {
            "icir": F.try_divide(F.col("mean_ic"), F.col("sd_ic")),
            "t_stat": F.try_divide(F.col("mean_ic") * F.sqrt("n_days"), F.col("sd_ic")),
            "sign": F.when(F.col("mean_ic") > 0, 1).otherwise(-1),
        }
    )


def tercile(x: Column, *keys: str) -> Column:
    """small, mid or large by exact thirds of the non-null ranks; null below three values."""
    w = Window.partitionBy(*keys)
    n = F.count(x).over(w)
    r = 3 * (F.rank().over(w.orderBy(x.asc_nulls_last())) - 1)
    return F.when(x.isNull() | (n < 3), None).when(r <= n - 1, "small").when(r <= 2 * (n - 1), "mid").otherwise("large")


def moments(rows: DataFrame, x: str, *keys: str) -> DataFrame:
    """n, mean, sd, sample skewness G1 and sample kurtosis (not excess) of a column."""
    n = F.col("n").cast("double")
    out = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3)
    return out.select(*keys, "n", "mean", "sd", skew.alias("skew"), kurt.alias("kurt"))


EULER = 0.5772156649015329


def expected_max_sharpe(n: float, sd: float = 1.0) -> float:
    """Expected maximum of n draws of N(0, sd^2)."""
    if n <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return sd * ((1 - EULER) * inv(1 - 1 / n) + EULER * inv(1 - 1 / (n * math.e)))


def deflated_sharpe(sr: float, n: int, skew: float, kurt: float, benchmark: float) -> float:
    """Probability that a Sharpe ratio over n periods exceeds the benchmark, given the returns' shape."""
    var = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return NormalDist().cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(max(var, 1e-12)))
