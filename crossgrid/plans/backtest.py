"""Backtests of signals: one plan from signal and labels to metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HORIZONS, MIN_NAMES, PERIODS_PER_YEAR, QUANTILE, SPLITS, Splits
from ..functions.ops import average_rank
from ..functions.stats import daily_ic, rank_scale, safe_corr, tercile
from ..sources.staging import staged


class HoldoutError(ValueError):
    """The holdout was asked for without a token."""


def in_split(name: str, splits: Splits = SPLITS, col: str = "date") -> Column:
    out = F.lit(False)
    for a, b in splits.parts(name):
        out = out | F.col(col).between(F.lit(a), F.lit(b))
    return out


def guard(split: str, splits: Splits = SPLITS, token: bool = False) -> None:
    if not token and any(b >= splits.holdout_start for _, b in splits.parts(split)):
        raise HoldoutError(f"{split} reaches into the holdout")


@dataclass(frozen=True)
class Spec:
    """What a backtest does to a signal. embargo is accepted for symmetry and has no effect on one split."""

    split: str = "val_a"
    horizon: int = 5
    extra_lag: int = 0
    cost_bps: float = 0.0
    neutralize: bool = False
    purge: int | None = None  # positions; null: the horizon
    embargo: int = 0
    subsample: dict = field(default_factory=dict)
    min_names: int = MIN_NAMES


def shift_signal(rows: DataFrame, lag: int) -> DataFrame:
    """The signal dated lag positions later; what falls off the calendar goes."""
    return rows if not lag else rows.withColumn("sig", F.lag("sig", lag).over(Window.partitionBy("symbol").orderBy("pos")))


def subsampled(rows: DataFrame, how: dict, regimes: DataFrame | None) -> DataFrame:
    unknown = set(how) - {"years", "exclude_symbols", "size_tercile", "min_turnover", "regime"}
    if unknown:
        raise ValueError(f"unknown subsample: {sorted(unknown)[0]}")
    if "years" in how:
        rows = rows.where(F.year("date").isin(*how["years"]))
    if "exclude_symbols" in how:
        rows = rows.where(~F.col("symbol").isin(*how["exclude_symbols"]))
    if "size_tercile" in how:
        rows = rows.withColumn("_size", tercile(F.col("size_proxy"), "date")).where(F.col("_size") == how["size_tercile"]).drop("_size")
    if "min_turnover" in how:
        rows = rows.where(F.exp("turnover_21") >= how["min_turnover"])
    if "regime" in how:
        rows = rows.join(regimes.where(how["regime"]).select("date"), "date", "left_semi")
    return rows


def before_holdout(purge: int, splits: Splits = SPLITS) -> Column:
    """Rows of the dense panel whose labels, ``purge`` positions after the next, end before the holdout's first day."""
    w = Window.partitionBy("symbol")
    end = F.coalesce(F.lead("date", 1 + purge).over(w.orderBy("pos")), F.max("date").over(w))
    return end < F.lit(splits.holdout_start)


def prepare(rows: DataFrame, spec: Spec, splits: Splits = SPLITS, regimes: DataFrame | None = None, token: bool = False) -> DataFrame:
    """Labelled panel rows with ``sig`` to those that count, with ``scaled`` in [-1, 1]."""
    guard(spec.split, splits, token)
    rows = shift_signal(rows, spec.extra_lag)
    if not token:
        purge = spec.horizon if spec.purge is None else spec.purge
        # labels know when they end, so that rows needn't go back to their symbol
        known = F.col(f"label_end_{purge}") < F.lit(splits.holdout_start) if f"label_end_{purge}" in rows.columns else before_holdout(purge, splits)
        rows = rows.withColumn("_open", known).where("_open").drop("_open")
    rows = rows.where(in_split(spec.split, splits))
    rows = subsampled(rows.where("sig IS NOT NULL"), spec.subsample, regimes)
    day = Window.partitionBy("date")
    least = 1 if "size_tercile" in spec.subsample else spec.min_names
    rows = rows.withColumn("_n", F.count("sig").over(day)).where(F.col("_n") >= least).drop("_n")
    if spec.neutralize:
        rows = rows.withColumn("sig", F.col("sig") - F.avg("sig").over(Window.partitionBy("date", F.coalesce("sector", F.lit("__NA__")))))
    return rows.withColumn("scaled", rank_scale(F.col("sig"), "date"))


def book(rows: DataFrame, least: int = MIN_NAMES, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Weights of the top and bottom quintile; ties go by symbol."""
    d = rows.where("scaled IS NOT NULL AND fwd_ret_1 IS NOT NULL")
    day = Window.partitionBy(*keys)
    d = d.withColumns({"_n": F.count("*").over(day), "_p": F.row_number().over(day.orderBy("scaled", "symbol"))})
    d = d.withColumn("_p", F.col("_p") / F.col("_n"))
    d = d.withColumns({"_long": F.col("_p") > 1 - QUANTILE, "_short": F.col("_p") <= QUANTILE})
    d = d.withColumns({"_nl": F.count_if("_long").over(day), "_ns": F.count_if("_short").over(day)})
    w = F.when(F.col("_long"), F.lit(1.0) / F.col("_nl")).when(F.col("_short"), F.lit(-1.0) / F.col("_ns")).otherwise(0.0)
    return d.where((F.col("_n") >= least) & (F.col("_nl") > 0) & (F.col("_ns") > 0)).select(*keys, "symbol", w.alias("w"), "fwd_ret_1")


def ls_daily(weights: DataFrame, cost_bps: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per day gross, turnover (sum of absolute changes of weights) and net. Each weight counts on its day and against the next one, so no grid is built."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy()
    days = weights.groupBy(*keys, "date").agg(F.sum(F.col("w") * F.col("fwd_ret_1")).alias("gross")).withColumn("i", F.row_number().over(by.orderBy("date")))
    own = weights.join(days.select(*keys, "date", "i"), [*keys, "date"])
    moves = own.select(*keys, "i", "symbol", "w").unionByName(own.select(*keys, (F.col("i") + 1).alias("i"), "symbol", (-F.col("w")).alias("w")))
    change = moves.groupBy(*keys, "i", "symbol").agg(F.sum("w").alias("w")).groupBy(*keys, "i").agg(F.sum(F.abs("w")).alias("dw"))
    return days.join(change, [*keys, "i"]).withColumn("net", F.col("gross") - cost_bps * 1e-4 * F.col("dw")).select(*keys, "date", "gross", "dw", "net")


def ls_metrics(daily: DataFrame, *keys: str) -> DataFrame:
    """sharpe, ann_return, turnover (one way), mdd, n_days."""
    by = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0) if keys else Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("_c", F.product(1 + F.col("net")).over(by))
    curve = curve.withColumn("_d", F.try_divide(F.col("_c"), F.max("_c").over(by)) - 1)
    n, sd = F.count("net"), F.stddev_samp("net")
    ok = (n >= 2) & (sd > 0)
    return curve.groupBy(*keys).agg(
        F.when(ok, F.try_divide(F.avg("net"), sd) * PERIODS_PER_YEAR**0.5).alias("sharpe"),
        F.when(ok, F.avg("net") * PERIODS_PER_YEAR).alias("ann_return"),
        (F.avg("dw") * 0.5).alias("turnover"),
        F.when(ok, F.min("_d")).alias("mdd"),
        n.alias("n_days"),
    )


def decay(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean rank IC by horizon."""
    long = rows.select(*keys, "date", "scaled", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_ret_{h}_demeaned").alias("y")) for h in horizons))).alias("x")).select(*keys, "date", "scaled", "x.horizon", "x.y")
    return daily_ic(long, "scaled", "y", keys=(*keys, "horizon", "date")).groupBy(*keys, "horizon").agg(F.avg("ic").alias("mean_ic"))


def daily_scores(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, horizon, date, ic and plain: rank and Pearson correlations of ``scaled`` and the labels of all horizons, in one aggregate; null where there is none."""
    long = rows.select(*keys, "date", "scaled", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_ret_{h}_demeaned").alias("y")) for h in horizons))).alias("x"))
    long = long.select(*keys, "date", F.col("x.horizon").alias("horizon"), "scaled", F.col("x.y").alias("y")).where("scaled IS NOT NULL AND y IS NOT NULL")
    by = (*keys, "horizon", "date")
    long = long.withColumns({"_a": average_rank(F.col("scaled"), *by), "_b": average_rank(F.col("y"), *by)})
    return long.groupBy(*by).agg(safe_corr(F.col("_a"), F.col("_b")).alias("ic"), safe_corr(F.col("scaled"), F.col("y")).alias("plain"))


def backtest(rows: DataFrame, spec: Spec = Spec(), splits: Splits = SPLITS, regimes: DataFrame | None = None, token: bool = False) -> DataFrame:
    """One row of metrics; nulls and n_days 0 where nothing is left. The rows that count are made once, and written; scores of all horizons come from one aggregate of them, the book from another."""
    horizons = tuple(sorted({*HORIZONS, spec.horizon}))
    ready = staged(prepare(rows, spec, splits, regimes, token).select("date", "symbol", "scaled", "fwd_ret_1", *(f"fwd_ret_{h}_demeaned" for h in horizons)))
    of = lambda h, c: F.when(F.col("horizon") == h, F.col(c))
    own, n = of(spec.horizon, "ic"), F.count(of(spec.horizon, "ic"))
    curve = F.array(*(F.struct(F.lit(h).alias("key"), F.avg(of(h, "ic")).alias("value")) for h in HORIZONS))
    scored = daily_scores(ready, horizons).agg(
        F.avg(own).alias("rank_ic"), F.try_divide(F.avg(own), F.stddev_samp(own)).alias("icir"), F.try_divide(F.avg(own) * F.sqrt(n), F.stddev_samp(own)).alias("t_stat"), F.when(F.avg(own) > 0, 1).otherwise(-1).alias("sign"), n.alias("n_days"),
        F.avg(of(spec.horizon, "plain")).alias("ic"), curve.alias("decay"),
    )
    least = 1 if "size_tercile" in spec.subsample else spec.min_names
    money = ls_metrics(ls_daily(book(ready, least), spec.cost_bps)).drop("n_days")
    curve = F.map_from_entries(F.filter("decay", lambda x: x["value"].isNotNull()))
    return scored.crossJoin(money).select("rank_ic", "icir", "t_stat", "sign", "n_days", "ic", *money.columns, curve.alias("decay"))


def regime_labels(labels: DataFrame) -> DataFrame:
    """Per date bull, bear, calm, volatile, highvol, from the market's mean next return with windows that only grow backwards. A row per date, in one task."""
    mkt = labels.groupBy("date").agg(F.avg("fwd_ret_1").alias("m"))
    w = Window.orderBy("date")
    w63, w21, all_ = w.rowsBetween(-62, 0), w.rowsBetween(-20, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    d = mkt.withColumns({"cum": F.when(F.count("m").over(w63) >= 40, F.product(1 + F.col("m")).over(w63) - 1), "vol": F.when(F.count("m").over(w21) >= 10, F.stddev_samp("m").over(w21))})
    many = F.count("vol").over(all_) >= 40
    d = d.withColumns({"med": F.when(many, F.percentile("vol", 0.5).over(all_)), "top": F.when(many, F.percentile("vol", 2.0 / 3.0).over(all_))})
    flags = {"bull": F.col("cum") > 0.05, "bear": F.col("cum") < -0.05, "calm": F.col("vol") <= F.col("med"), "volatile": F.col("vol") > F.col("med"), "highvol": F.col("vol") >= F.col("top")}
    return d.select("date", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()))


def purge_embargo(calendar: DataFrame, test: Column, horizon: int, embargo: int) -> DataFrame:
    """date, pos and state (test, purged, embargoed, train): training days whose labels reach into a run of test days, or follow it too soon, are taken out."""
    days = calendar.withColumn("is_test", test)
    runs = days.where("is_test").withColumn("run", F.col("pos") - F.row_number().over(Window.orderBy("pos"))).groupBy("run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    hit = days.join(runs, (F.col("pos") >= F.col("a") - horizon - 1) & (F.col("pos") <= F.col("b") + embargo), "left")
    state = F.when(F.bool_or("is_test"), "test").when(F.bool_or(F.col("pos") < F.col("a")), "purged").when(F.bool_or(F.col("pos") > F.col("b")), "embargoed").otherwise("train")
    return hit.groupBy("date", "pos").agg(state.alias("state"))
