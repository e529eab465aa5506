"""Gates: what a signal adds to known factors, and whether its statistics survive many trials."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MIN_NAMES, SPLITS, Splits
from ..functions.linear import residuals
from .backtest import HoldoutError
from ..functions.stats import daily_ic, deflated_sharpe, expected_max_sharpe, ic_summary, moments, safe_corr

#: Thresholds of the second gate.
MIN_MARGINAL_IC, MIN_DSR, MIN_T, MAX_PBO, MIN_DAYS, MIN_RETENTION = 0.01, 0.95, 3.0, 0.5, 60, 0.3


def orthogonalize(rows: DataFrame, sig: str, factors: list[str], out: str = "resid") -> DataFrame:
    """Per date the residual of ``sig`` on all factors and a constant, on rows that have all of them; factors may depend on each other."""
    return residuals(rows, sig, factors, out, "date")


def marginal_ic(rows: DataFrame, sig: str, factors: list[str], label: str, least: int = MIN_NAMES) -> DataFrame:
    """Mean rank IC of the residual, and of the signal itself."""
    resid = orthogonalize(rows, sig, factors)
    a = ic_summary(daily_ic(resid, "resid", label, least=least)).select(F.col("mean_ic").alias("marginal_ic"), F.col("t_stat"), F.col("n_days"), F.col("sign"))
    return a.crossJoin(daily_ic(rows, sig, label, least=least).agg(F.avg("ic").alias("raw_ic")))


def walk_forward(ics: DataFrame, folds: DataFrame, drop: int, splits: Splits = SPLITS) -> DataFrame:
    """Per fold (fold, start, end) of IC days: mean, ir, t over the days after the first ``drop``. Folds that reach into the holdout are refused."""
    last = folds.agg(F.max("end")).first()[0]  # a row per fold
    if last is not None and last >= splits.holdout_start:
        raise HoldoutError(f"folds up to {last} reach into the holdout")
    days = ics.join(folds, F.col("date").between(F.col("start"), F.col("end"))).withColumn("_i", F.row_number().over(Window.partitionBy("fold").orderBy("date")))
    return ic_summary(days.where(F.col("_i") > drop), "fold").select("fold", "mean_ic", F.col("icir").alias("ir"), "t_stat", "n_days")


def cscv_pbo(returns: DataFrame, n_blocks: int = 8, purge: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of returns (keys, t, strategy, r), per key: how often the best half-sample strategy falls below the median in the other half. Blocks are of equal length over all keys, the remainder at the end is dropped, as are the first ``purge`` rows of each block. Sharpe ratios of halves come from sums per block."""
    spark = returns.sparkSession
    length = returns.agg((F.max("t") + 1 - (F.max("t") + 1) % n_blocks).alias("_len"))
    stats = returns.crossJoin(length).where((F.col("t") < F.col("_len")) & (F.col("t") % (F.col("_len") / n_blocks) >= purge)).withColumn("block", F.floor(F.col("t") * n_blocks / F.col("_len")).cast("int")).groupBy(*keys, "block", "strategy").agg(F.count("r").alias("n"), F.sum("r").alias("s1"), F.sum(F.col("r") * F.col("r")).alias("s2"))
    splits = spark.createDataFrame([(i, b, b in c) for i, c in enumerate(combinations(range(n_blocks), n_blocks // 2)) for b in range(n_blocks)], "split int, block int, inside boolean")
    half = stats.join(splits, "block").groupBy(*keys, "split", "inside", "strategy").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    mean = F.col("s1") / F.col("n")
    sd = F.sqrt(F.greatest((F.col("s2") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    half = half.withColumn("sr", F.coalesce(F.try_divide(mean, sd), F.lit(0.0)))
    best = half.where("inside").groupBy(*keys, "split").agg(F.max_by("strategy", F.struct("sr", "strategy")).alias("strategy"))
    w = Window.partitionBy(*keys, "split")
    outside = half.where("NOT inside").withColumn("rank", (F.rank().over(w.orderBy("sr")) + (F.count("*").over(Window.partitionBy(*keys, "split", "sr")) - 1) / 2) / (F.count("*").over(w) + 1))
    return best.join(outside, [*keys, "split", "strategy"]).select(*keys, "split", "strategy", F.col("rank").alias("oos_rank"), F.ln(F.col("rank") / (1 - F.col("rank"))).alias("logit"))


def pbo(returns: DataFrame, n_blocks: int = 8, purge: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    return cscv_pbo(returns, n_blocks, purge, keys).groupBy(*keys).agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.count("*").alias("n_splits"))


def drawn(names: DataFrame, draws: int, size: int) -> DataFrame:
    """draw, symbol: for each of the draws ``size`` names, those of smallest digest. A row per name and draw."""
    d = names.select("symbol").distinct().crossJoin(names.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw")))
    order = F.md5(F.concat_ws("|", F.lit("draw"), F.col("draw").cast("string"), "symbol").cast("binary"))
    return d.withColumn("_k", F.row_number().over(Window.partitionBy("draw").orderBy(order, "symbol"))).where(F.col("_k") <= size).select("draw", "symbol")


def pair_corr(rows: DataFrame, key: str, name: str, value: str, names: list[str] | None = None, *by: str) -> DataFrame:
    """(by, a, b, corr) for all pairs of names over shared keys. With the names known, a row per key has a column for each, and all pairs are correlated in one aggregate, without a join; otherwise names meet by key, as many rows as pairs."""
    if names is None:
        x, y = rows.select(*by, key, F.col(name).alias("a"), F.col(value).alias("x")), rows.select(*by, key, F.col(name).alias("b"), F.col(value).alias("y"))
        return x.join(y, [*by, key]).groupBy(*by, "a", "b").agg(safe_corr(F.col("x"), F.col("y")).alias("corr"))
    wide = rows.groupBy(*by, key).agg(*(F.max(F.when(F.col(name) == n, F.col(value))).alias(f"_{i}") for i, n in enumerate(names)))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    both = {(i, j): F.col(f"_{i}").isNotNull() & F.col(f"_{j}").isNotNull() for i, j in pairs}
    cells = {(i, j): F.struct(safe_corr(F.when(both[i, j], F.col(f"_{i}")), F.when(both[i, j], F.col(f"_{j}"))).alias("corr"), F.count_if(both[i, j]).alias("n")).alias(f"{i}_{j}") for i, j in pairs}
    one = wide.groupBy(*by).agg(*cells.values())
    every = [(i, j, f"{min(i, j)}_{max(i, j)}") for i in range(len(names)) for j in range(len(names))]
    long = one.select(*by, F.explode(F.array(*(F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"`{c}`.corr").alias("corr"), F.col(f"`{c}`.n").alias("n")) for i, j, c in every))).alias("x"))
    return long.select(*by, "x.a", "x.b", "x.corr", "x.n").where("n > 0").drop("n")


def participation(corr: DataFrame) -> DataFrame:
    """Effective number of series: M^2 over the sum of squared correlations, as the eigenvalues' participation ratio is."""
    return corr.agg((F.count_distinct("a") * F.count_distinct("a") / F.sum(F.col("corr") * F.col("corr"))).alias("effective_n"))


def effective_trials(keys: DataFrame, corr: DataFrame) -> DataFrame:
    """keys (name, cluster): the sum over clusters of 1 + (m - 1)(1 - mean absolute correlation inside)."""
    inside = corr.join(keys.select(F.col("name").alias("a"), F.col("cluster")), "a").join(keys.select(F.col("name").alias("b"), F.col("cluster").alias("other")), "b").where("cluster = other AND a < b").groupBy("cluster").agg(F.avg(F.abs("corr")).alias("c"))
    each = keys.groupBy("cluster").agg(F.count("*").alias("m")).join(inside, "cluster", "left")
    return each.agg(F.sum(1 + (F.col("m") - 1) * (1 - F.coalesce("c", F.lit(0.0)))).alias("effective_trials"))


def dsr(ics: DataFrame, n_trials: float, trial_var: float | None = None) -> dict[str, float]:
    """Deflated Sharpe ratio of an IC series against the best of n_trials."""
    m = moments(ics, "ic").first()
    n = m.n or 0
    if n < 4 or not m.sd:
        return {"dsr": 0.0, "sr": 0.0, "benchmark": 0.0, "n": n}
    sr = m["mean"] / m.sd
    benchmark = expected_max_sharpe(max(n_trials, 1.0), max(trial_var or 0.0, 1 / n) ** 0.5)
    return {"dsr": deflated_sharpe(sr, n, m["skew"], m.kurt, benchmark), "sr": sr, "benchmark": benchmark, "n": n}


def folds(spark: SparkSession, start: str, end: str, train_years: int, step_months: int) -> DataFrame:
    """fold, start, end: test windows of step_months from start + train_years on."""
    first = F.add_months(F.lit(start).cast("date"), 12 * train_years)
    starts = spark.range(1).select(F.posexplode(F.sequence(first, F.lit(end).cast("date"), F.expr(f"INTERVAL {step_months} MONTHS"))).alias("fold", "start"))
    return starts.select("fold", "start", F.least(F.date_sub(F.add_months("start", step_months), 1), F.lit(end).cast("date")).alias("end"))
