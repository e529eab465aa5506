"""Least squares on many columns within keys, all as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is left of a column's variance, as a share of it, below which it depends on the columns taken before.
TOLERANCE = 1e-10


def _eliminated(a: Column, k: int, tolerance: float) -> Column:
    """Of a (k + 1) x (k + 1) correlation matrix by rows, whose last row is the target: the same after elimination on pivots, each time the column of which most is left,
    as a pivoted Cholesky factorisation takes them, until nothing is. Its first k entries of the last column are coefficients; those of columns that were not taken have no meaning, ``used`` tells."""
    m = k + 1
    at = lambda s, i, j: F.get(s["a"], (i * m + j).cast("int"))

    def step(s: Column, _: Column) -> Column:
        left = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(F.get(s["used"], i), F.lit(-1.0)).otherwise(at(s, i, i)))
        v = F.array_max(left)
        p = F.array_position(left, v).cast("int") - 1

        def entry(x: Column, t: Column) -> Column:
            i, j = F.floor(t / m).cast("int"), (t % m).cast("int")
            row, col = at(s, p, j), at(s, i, p)
            return F.when((i == p) & (j == p), -1 / v).when(i == p, row / v).when(j == p, col / v).otherwise(x - col * row / v)

        took = F.struct(F.transform(s["a"], entry).alias("a"), F.transform(s["used"], lambda u, i: u | (i == p)).alias("used"))
        return F.when(v > tolerance, took).otherwise(s)

    start = F.struct(a.alias("a"), F.array(*[F.lit(False)] * k).alias("used"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step)


def residuals(rows: DataFrame, target: str, columns: list[str], out: str, *keys: str, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows and ``out``: the target less its least-squares fit on the columns and a constant, per key, over rows that have all of them.

    Columns may be constant or depend on each other: the fit is that on as many as are independent, so the residual is the one of the fit of least norm; a target that depends on them has zeros.
    Where a key is null or has fewer than len(columns) + 2 such rows, and on rows that lack one of them, the target stays as it is. Moments are sums about means, combined before they meet, and come back to the rows as one row per key."""
    k = len(columns)
    if not k:
        return rows.withColumn(out, F.col(target))
    names = [*columns, target]
    known = reduce(lambda p, c: p & F.col(c).isNotNull(), names, F.lit(True))
    part = {c: F.when(known, F.col(c).cast("double")) for c in names}
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    fit = rows.groupBy(*keys).agg(F.count(part[target]).alias("_n"), F.array(*(F.avg(part[c]) for c in names)).alias("_mean"), F.array(*(F.covar_pop(part[names[i]], part[names[j]]) for i, j in pairs)).alias("_c"))
    place = {p: x for x, p in enumerate(pairs)}
    cov = lambda i, j: F.get("_c", F.lit(place[min(i, j), max(i, j)]))
    # a column that rounding alone moves is a constant
    fit = fit.withColumn("_sd", F.array(*(F.when(F.sqrt(cov(i, i)) > 1e-14 * F.abs(F.get("_mean", F.lit(i))), F.sqrt(cov(i, i))).otherwise(0.0) for i in range(k + 1))))
    sd = lambda i: F.get("_sd", F.lit(i))
    fit = fit.withColumn("_a", F.array(*(F.coalesce(F.try_divide(cov(i, j), sd(i) * sd(j)), F.lit(0.0)) for i in range(k + 1) for j in range(k + 1))))
    fit = fit.withColumn("_e", _eliminated(F.col("_a"), k, tolerance))
    slopes = F.array(*(F.when(F.get("_e.used", F.lit(i)), F.get("_e.a", F.lit(i * (k + 1) + k)) * sd(k) / sd(i)).otherwise(0.0) for i in range(k)))
    rest = F.get("_e.a", F.lit((k + 1) ** 2 - 1)) > tolerance
    fit = fit.where(F.col("_n") >= k + 2).select(*(F.col(c).alias(f"_key_{c}") for c in keys), "_mean", slopes.alias("_slope"), rest.alias("_rest"))
    on = reduce(lambda p, c: p & (F.col(c) == F.col(f"_key_{c}")), keys, F.lit(True))
    both = rows.join(fit, on, "left")
    value = F.col(target) - F.get("_mean", F.lit(k)) - reduce(lambda a, b: a + b, (F.get("_slope", F.lit(i)) * (F.col(c) - F.get("_mean", F.lit(i))) for i, c in enumerate(columns)))
    return both.withColumn(out, F.when(known & F.col("_slope").isNotNull(), F.when(F.col("_rest"), value).otherwise(0.0)).otherwise(F.col(target))).drop("_mean", "_slope", "_rest", *(f"_key_{c}" for c in keys))
