"""Seeded panels with known properties, made by Spark; their bits are those of this seed and partitioning alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def normal(seed: int, *keys: str) -> Column:
    """A standard normal of a hash of the keys: the same for a row wherever it is computed."""
    def uniform(k: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *keys), F.lit(1 << 52)) + 0.5) / (1 << 52)

    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * F.lit(3.141592653589793) * uniform(2))


def grid(spark: SparkSession, days: int, names: int, start: str = "1996-01-01") -> DataFrame:
    rows = spark.range(days * names).select((F.col("id") % days).cast("int").alias("pos"), F.floor(F.col("id") / days).cast("int").alias("i"))
    return rows.select("pos", F.format_string("S%03d", "i").alias("symbol"), F.date_add(F.lit(start).cast("date"), F.col("pos")).alias("date"), F.concat(F.lit("sector"), (F.col("i") % 5).cast("string")).alias("sector"))


def ohlcv(spark: SparkSession, days: int = 800, names: int = 40, seed: int = 42, gaps: float = 0.015) -> DataFrame:
    """Geometric walks with 25% yearly volatility, missing days, and every twelfth name gone after two thirds."""
    w = Window.partitionBy("symbol").orderBy("pos")
    g = grid(spark, days, names).withColumn("close", 100 * F.exp(F.sum(0.25 / 252**0.5 * normal(seed, "symbol", "pos")).over(w)))
    g = g.withColumns({"open": F.col("close") * F.exp(0.002 * normal(seed + 1, "symbol", "pos")), "volume": F.floor(1e5 * F.exp(0.5 * normal(seed + 2, "symbol", "pos"))).cast("double")})
    g = g.withColumns({"high": F.greatest("open", "close") * 1.002, "low": F.least("open", "close") * 0.998, "vwap": (F.col("open") + F.col("close")) / 2, "n_trades": F.floor(F.col("volume") / 50).cast("double")})
    here = F.pmod(F.xxhash64(F.lit(seed + 3), "symbol", "pos"), F.lit(10_000)) >= int(gaps * 10_000)
    gone = (F.pmod(F.xxhash64(F.lit(seed), "symbol"), F.lit(12)) == 0) & (F.col("pos") > days * 2 // 3)
    return g.where(here & ~gone)


def planted(spark: SparkSession, days: int = 600, names: int = 60, seed: int = 42, ic: float = 0.04) -> DataFrame:
    """date, symbol, pos, sector, fwd_ret_1 (and demeaned), with a signal of a known information coefficient, a noise signal, and a leak."""
    g = grid(spark, days, names).withColumn("fwd_ret_1", 0.02 * normal(seed, "symbol", "pos"))
    g = g.withColumn("fwd_ret_1_demeaned", F.col("fwd_ret_1") - F.avg("fwd_ret_1").over(Window.partitionBy("date")))
    return g.withColumns({"planted": ic * F.col("fwd_ret_1") / 0.02 + (1 - ic * ic) ** 0.5 * normal(seed + 5, "symbol", "pos"), "noise": normal(seed + 6, "symbol", "pos"), "leak": F.col("fwd_ret_1")})


def forward_filled(rows: DataFrame, *columns: str) -> DataFrame:
    """The grid with gaps filled by the last value before them."""
    w = Window.partitionBy("symbol").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def membership(spark: SparkSession, days: int = 800, names: int = 60, size: int = 40, seed: int = 42) -> DataFrame:
    """pos, date, symbol, place: the ``size`` names that lead each month of 21 days; order drifts, so some names move in and out."""
    g = grid(spark, days, names).withColumn("_month", F.floor(F.col("pos") / 21))
    g = g.withColumn("_score", normal(seed, "symbol") + 0.3 * normal(seed + 1, "symbol", "_month"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("_score"), "symbol"))).where(F.col("place") <= size).select("pos", "date", "symbol", "place")


def symbols(spark: SparkSession, names: int = 40) -> DataFrame:
    """symbol, sector, isin."""
    return grid(spark, 1, names).select("symbol", "sector", F.concat(F.lit("INE"), F.lpad(F.substring("symbol", 2, 10), 9, "0")).alias("isin"))


def ar1(seed: int, rho: float, *keys: str, pos: str = "pos", depth: int = 128) -> Column:
    """A persistent standard normal per key: innovations of the last ``depth`` positions weighted by powers of rho, from hashes, so no row waits for another."""
    at = F.sequence(F.lit(0), F.lit(depth - 1))
    total = F.aggregate(at, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(rho), k) * normal(seed, *keys, F.col(pos) - k))
    return (1 - rho * rho) ** 0.5 * total


def world(spark: SparkSession, days: int = 600, names: int = 40, seed: int = 42, rho: float = 0.92, edge: float = 0.1) -> DataFrame:
    """The grid with a persistent ``latent`` per name and next returns that lean on it: pos, date, symbol, sector, latent, fwd_ret_1, fwd_ret_1_demeaned."""
    g = grid(spark, days, names).withColumn("latent", ar1(seed, rho, "symbol"))
    g = g.withColumn("fwd_ret_1", 0.02 * (edge * F.col("latent") + (1 - edge * edge) ** 0.5 * normal(seed + 1, "symbol", "pos")))
    return g.withColumn("fwd_ret_1_demeaned", F.col("fwd_ret_1") - F.avg("fwd_ret_1").over(Window.partitionBy("date")))


def features(spark: SparkSession, days: int = 600, names: int = 60, seed: int = 42) -> DataFrame:
    """date, symbol, pos, mom, vol, size: loadings of which mom is persistent, vol is fixed per name but for noise, and size drifts."""
    g = grid(spark, days, names)
    return g.select("date", "symbol", "pos", ar1(seed, 0.92, "symbol").alias("mom"), F.exp(0.3 * normal(seed + 1, "symbol") + 0.05 * normal(seed + 2, "symbol", "pos")).alias("vol"), (10 + normal(seed + 3, "symbol") + 0.1 * ar1(seed + 4, 0.99, "symbol")).alias("size"))
