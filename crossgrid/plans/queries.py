"""Every query by name: what Spark runs, and the DuckDB SQL that must give the same rows.

Floats are rounded where they leave a query, as sums in another order differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import HORIZONS, MIN_NAMES, SPLITS
from ..functions import stats
from ..oracles import sql
from ..sources import panel as source
from . import backtest, gates, prices, universe
from .formula import evaluate, with_formulas
from .zoo import ZOO

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SIGNAL = "rank(mul(-1, delta(close, 5)))"
FACTORS = {"f1": "sub(div(close, delay(close, 21)), 1)", "f2": "mul(-1, ts_std(returns, 21))"}


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries of the name {name}")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def labelled(spark: SparkSession, sf_dir: str, formula: str = SIGNAL, extra: dict[str, str] | None = None) -> DataFrame:
    """The panel with labels, ``sig``, and further formulas."""
    rows = source.fwd_labels(source.panel(spark, sf_dir))
    return with_formulas(rows, {"sig": formula} | (extra or {}))


LAB = [sql.panel(), sql.labels(), sql.formula(SIGNAL, "lab")]

# panel

PANEL_COLS = ("open", "high", "low", "close", "volume", "vwap", "n_trades", "delivery_pct", "returns", "size_proxy")


@query("panel_ohlcv", sql.query([sql.panel()], "SELECT date, symbol, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, volume, round(vwap, 9) AS vwap, n_trades, round(delivery_pct, 9) AS delivery_pct, sector FROM bars"))
def panel_ohlcv(spark, sf_dir):
    b = source.bars(source.trades(spark, sf_dir))
    return b.select("date", "symbol", r("open", 9).alias("open"), r("high", 9).alias("high"), r("low", 9).alias("low"), r("close", 9).alias("close"), "volume", r("vwap", 9).alias("vwap"), "n_trades", r("delivery_pct", 9).alias("delivery_pct"), "sector")


@query("panel_dense", sql.query([sql.panel()], "SELECT date, symbol, CAST(pos AS INTEGER) AS pos, sector, " + ", ".join(f"round({c}, 9) AS {c}" for c in PANEL_COLS) + " FROM panel"))
def panel_dense(spark, sf_dir):
    return source.panel(spark, sf_dir).select("date", "symbol", "pos", "sector", *(r(c, 9).alias(c) for c in PANEL_COLS))


@query("panel_supplier_gaps", sql.query([sql.panel("week", "supplier")], "SELECT date, symbol, round(close, 9) AS close, round(returns, 9) AS returns FROM panel"))
def panel_supplier_gaps(spark, sf_dir):
    return source.panel(spark, sf_dir, by="supplier").select("date", "symbol", r("close", 9).alias("close"), r("returns", 9).alias("returns"))


LABEL_COLS = [f"fwd_ret_{h}{d}" for h in HORIZONS for d in ("", "_demeaned")]


@query("labels_fwd", sql.query(LAB[:2], "SELECT date, symbol, " + ", ".join(f"round({c}, 6) AS {c}" for c in LABEL_COLS) + " FROM lab"))
def labels_fwd(spark, sf_dir):
    return source.fwd_labels(source.panel(spark, sf_dir)).select("date", "symbol", *(r(c).alias(c) for c in LABEL_COLS))


FEATURES = {
    "mom_21": "sub(div(delay(close, 1), delay(close, 22)), 1)",
    "mom_126": "sub(div(delay(close, 21), delay(close, 147)), 1)",
    "rev_5": "mul(-1, sub(div(close, delay(close, 5)), 1))",
    "vol_21": "mul(ts_std(returns, 21), 15.874507866387544)",
    "beta_63": "div(sub(ts_mean(mul(returns, sub(returns, demean_cs(returns))), 63), mul(ts_mean(returns, 63), ts_mean(sub(returns, demean_cs(returns)), 63))), sub(ts_mean(pow(sub(returns, demean_cs(returns)), 2), 63), pow(ts_mean(sub(returns, demean_cs(returns)), 63), 2)))",
    "amihud_21": "mul(ts_mean(div(abs(returns), mul(close, volume)), 21), 1000000)",
    "turnover_21": "log(ts_mean(mul(close_raw, volume_raw), 21))",
    "dist_52wh": "sub(div(close, ts_max(close, 252)), 1)",
    "max_ret_21": "ts_max(returns, 21)",
}


def _features_sql() -> str:
    parts, last = [sql.panel()], "panel"
    for k, f in FEATURES.items():
        parts.append(sql.formula(f, last, k, f"x_{k}"))
        last = k
    return sql.query(parts, "SELECT date, symbol, " + ", ".join(f"round({last}.{k}, 6) AS {k}" for k in FEATURES) + f", round(delivery_pct, 6) AS delivery_pct, round(size_proxy, 6) AS size_proxy, sector FROM {last}")


@query("features_all", _features_sql())
def features_all(spark, sf_dir):
    rows = source.panel(spark, sf_dir)
    return evaluate(rows, FEATURES, ("date", "symbol", "delivery_pct", "size_proxy", "sector")).select("date", "symbol", "sector", *(r(c).alias(c) for c in (*FEATURES, "delivery_pct", "size_proxy")))


@query("splits", sql.query([sql.panel()], "SELECT s AS split, count(DISTINCT date) AS n_days, min(date) AS first, max(date) AS last FROM (SELECT date, " + "CASE " + " ".join(f"WHEN {sql.split(k)} THEN '{k}'" for k in SPLITS.ranges) + " END AS s FROM panel) GROUP BY s"))
def splits(spark, sf_dir):
    which = F.coalesce(*(F.when(backtest.in_split(k), k) for k in SPLITS.ranges))
    return source.panel(spark, sf_dir).groupBy(which.alias("split")).agg(F.count_distinct("date").alias("n_days"), F.min("date").alias("first"), F.max("date").alias("last"))


# operators and known formulas

OPERATOR_FORMULAS = {
    "rank": "rank(volume)", "scale": "scale(returns)", "demean_cs": "demean_cs(returns)", "zscore_cs": "zscore_cs(vwap)", "sector_neutral": "sector_neutral(returns, sector)",
    "delay": "delay(close, 3)", "delta": "delta(close, 5)", "ts_mean": "ts_mean(close, 10)", "ts_std": "ts_std(returns, 21)", "ts_min": "ts_min(low, 10)", "ts_max": "ts_max(high, 10)", "ts_sum": "ts_sum(volume, 5)",
    "ts_rank": "ts_rank(volume, 9)", "ts_argmax": "ts_argmax(volume, 10)", "ts_product": "ts_product(add(returns, 1), 5)", "decay_linear": "decay_linear(close, 8)", "correlation": "correlation(open, volume, 10)", "covariance": "covariance(close, vwap, 12)",
    "add": "add(open, close)", "sub": "sub(close, open)", "mul": "mul(close, returns)", "div": "div(close, sub(volume, volume))", "pow": "pow(returns, 0.5)", "log": "log(returns)", "abs": "abs(returns)", "sign": "sign(returns)", "signed_power": "signed_power(returns, 2)",
    "min": "min(open, delay(close, 1))", "max": "max(open, delay(close, 1))", "lt": "lt(open, close)", "gt": "gt(open, close)", "le": "le(volume, delay(volume, 1))", "ge": "ge(volume, delay(volume, 1))", "eq": "eq(n_trades, delay(n_trades, 1))", "if_else": "if_else(gt(returns, 0), close, delay(open, 1))",
}


#: Values are far from one: what they are multiplied by before rounding.
FACTOR = {"zoo_classical_illiquidity_amihud": 1e6}
#: Values are large: rounded to fewer digits.
DIGITS = {"op_ts_sum": 4, "op_covariance": 3, "zoo_classical_turnover": 2, "zoo_alpha101_012": 9}


def _formula_query(name: str, formula: str) -> None:
    factor, digits = FACTOR.get(name, 1.0), DIGITS.get(name, 6)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(source.panel(spark, sf_dir), {"value": formula}).select("date", "symbol", r(F.col("value") * factor, digits).alias("value"))

    query(name, sql.query([sql.panel(), sql.formula(formula)], f"SELECT date, symbol, round(sig * {factor}, {digits}) AS value FROM sig"))(run)


for _name, _formula in OPERATOR_FORMULAS.items():
    _formula_query(f"op_{_name}", _formula)
for _name, _formula in ZOO.items():
    _formula_query(f"zoo_{_name}", _formula)


# information coefficients and books

TRAIN = sql.split("val_a")
PREPARED = [*LAB, f"kept AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM sig WHERE sig IS NOT NULL AND {TRAIN})", f"ready AS (SELECT * REPLACE (sig AS sig), CASE WHEN n <= 1 THEN 0 ELSE 2.0 * (({sql.average_rank('round(sig, 12)')}) - 1) / (n - 1) - 1 END AS scaled FROM kept WHERE n >= {MIN_NAMES})"]


def ic_cte(x: str = "scaled", y: str = "fwd_ret_5_demeaned", source_: str = "ready", spearman: bool = True, keys: str = "date", out: str = "ics", least: int = 0) -> str:
    both = f"(SELECT * FROM {source_} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    a, b = (sql.average_rank(x, keys), sql.average_rank(y, keys)) if spearman else (x, y)
    return f"{out} AS (SELECT * FROM (SELECT {keys}, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic, count(*) AS n FROM (SELECT {keys}, {a} AS a, {b} AS b FROM {both}) GROUP BY {keys}) WHERE ic IS NOT NULL AND n >= {least})"


IC_SUMMARY = "round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS sd_ic, count(*) AS n_days, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(ic) * sqrt(count(*)) / stddev_samp(ic), 6) AS t_stat, CASE WHEN avg(ic) > 0 THEN 1 ELSE -1 END AS sign"


def summary(df: DataFrame) -> DataFrame:
    return df.select(*(r(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("ic_daily_rank", sql.query([*PREPARED, ic_cte()], "SELECT date, round(ic, 6) AS ic FROM ics"))
def ic_daily_rank(spark, sf_dir):
    return summary(stats.daily_ic(backtest.prepare(labelled(spark, sf_dir), backtest.Spec()), "scaled", "fwd_ret_5_demeaned"))


@query("ic_daily_pearson", sql.query([*PREPARED, ic_cte(spearman=False)], "SELECT date, round(ic, 6) AS ic FROM ics"))
def ic_daily_pearson(spark, sf_dir):
    return summary(stats.daily_ic(backtest.prepare(labelled(spark, sf_dir), backtest.Spec()), "scaled", "fwd_ret_5_demeaned", spearman=False))


@query("ic_summary", sql.query([*PREPARED, ic_cte()], f"SELECT {IC_SUMMARY} FROM ics"))
def ic_summary(spark, sf_dir):
    return summary(stats.ic_summary(stats.daily_ic(backtest.prepare(labelled(spark, sf_dir), backtest.Spec()), "scaled", "fwd_ret_5_demeaned")))


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT date, scaled, {h} AS horizon, fwd_ret_{h}_demeaned AS y FROM ready" for h in HORIZONS) + ")"


@query("ic_decay", sql.query([*PREPARED, _LONG, ic_cte("scaled", "y", "long", keys="horizon, date")], "SELECT horizon, round(avg(ic), 6) AS mean_ic FROM ics GROUP BY horizon"))
def ic_decay(spark, sf_dir):
    return summary(backtest.decay(backtest.prepare(labelled(spark, sf_dir), backtest.Spec())))


BOOK = [
    f"b0 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY scaled, symbol) * 1.0 / count(*) OVER (PARTITION BY date) AS p, count(*) OVER (PARTITION BY date) AS m FROM ready WHERE scaled IS NOT NULL AND fwd_ret_1 IS NOT NULL)",
    f"book AS (SELECT date, symbol, fwd_ret_1, CASE WHEN p > 0.8 THEN 1.0 / sum(CASE WHEN p > 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY date) WHEN p <= 0.2 THEN -1.0 / sum(CASE WHEN p <= 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY date) ELSE 0.0 END AS w FROM b0 WHERE m >= {MIN_NAMES})",
    "days AS (SELECT date, sum(w * fwd_ret_1) AS gross, row_number() OVER (ORDER BY date) AS i FROM book GROUP BY date)",
    "names AS (SELECT DISTINCT symbol FROM book)",
    "wide AS (SELECT d.i, d.date, n.symbol, coalesce(b.w, 0) AS w FROM days d CROSS JOIN names n LEFT JOIN book b ON b.date = d.date AND b.symbol = n.symbol)",
    "moved AS (SELECT i, sum(abs(w - before)) AS dw FROM (SELECT i, w, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY i), 0) AS before FROM wide) GROUP BY i)",
]
DAILY = BOOK + ["daily AS (SELECT date, gross, dw, gross - {cost} * 1e-4 * dw AS net FROM days JOIN moved USING (i))"]
METRICS = "SELECT round(avg(net) / stddev_samp(net) * sqrt(252), 4) AS sharpe, round(avg(net) * 252, 6) AS ann_return, round(avg(dw) / 2, 6) AS turnover, round(min(curve / top - 1), 6) AS mdd, count(*) AS n_days FROM (SELECT *, max(curve) OVER (ORDER BY date) AS top FROM (SELECT *, product(1 + net) OVER (ORDER BY date) AS curve FROM daily))"


def daily_ctes(cost: float) -> list[str]:
    return [c.replace("{cost}", str(cost)) for c in DAILY]


@query("ls_daily", sql.query([*PREPARED, *daily_ctes(15.0)], "SELECT date, round(gross, 6) AS gross, round(dw, 6) AS dw, round(net, 6) AS net FROM daily"))
def ls_daily(spark, sf_dir):
    return summary(backtest.ls_daily(backtest.book(backtest.prepare(labelled(spark, sf_dir), backtest.Spec())), 15.0))


@query("ls_metrics", sql.query([*PREPARED, *daily_ctes(15.0)], METRICS))
def ls_metrics(spark, sf_dir):
    out = backtest.ls_metrics(backtest.ls_daily(backtest.book(backtest.prepare(labelled(spark, sf_dir), backtest.Spec())), 15.0))
    return out.select(r("sharpe", 4).alias("sharpe"), *(r(c).alias(c) for c in ("ann_return", "turnover", "mdd")), "n_days")


def _variant(name: str, spec: backtest.Spec, changed: list[str], extra: dict[str, str] | None = None) -> None:
    """A backtest whose SQL differs in the CTEs before the ICs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = labelled(spark, sf_dir, extra=extra)
        regimes = backtest.regime_labels(source.fwd_labels(source.panel(spark, sf_dir))) if "regime" in spec.subsample else None
        out = backtest.backtest(rows, spec, regimes=regimes)
        return out.select("n_days", "sign", r("sharpe", 4).alias("sharpe"), *(r(c).alias(c) for c in ("rank_ic", "ic", "icir", "t_stat", "ann_return", "turnover", "mdd")))

    y = f"fwd_ret_{spec.horizon}_demeaned"
    select = f"SELECT n_days, sign, sharpe, rank_ic, ic, icir, t_stat, ann_return, turnover, mdd FROM (SELECT round(avg(ic), 6) AS rank_ic, count(*) AS n_days, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(ic) * sqrt(count(*)) / stddev_samp(ic), 6) AS t_stat, CASE WHEN avg(ic) > 0 THEN 1 ELSE -1 END AS sign FROM ics) CROSS JOIN (SELECT round(avg(ic), 6) AS ic FROM plain) CROSS JOIN (SELECT * EXCLUDE (n_days) FROM ({METRICS}))"
    money = daily_ctes(spec.cost_bps)
    if "size_tercile" in spec.subsample:
        money = [c.replace(f"m >= {MIN_NAMES}", "m >= 5") for c in money]  # fewer have no quintile of one name
    query(name, sql.query([*changed, ic_cte(y=y), ic_cte(y=y, spearman=False, out="plain"), *money], select))(run)


def _ready(sig: str = "sig", where: str = "true", least: int = MIN_NAMES, more: tuple[str, ...] = (), lag: int = 0) -> list[str]:
    shifted = f"shifted AS (SELECT * REPLACE (lag(sig, {lag}) OVER (PARTITION BY symbol ORDER BY pos) AS sig) FROM sig)" if lag else "shifted AS (SELECT * FROM sig)"
    return [*LAB, *more, shifted, f"inside AS (SELECT * FROM shifted WHERE sig IS NOT NULL AND {TRAIN})", f"kept AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM inside WHERE {where})", f"flat AS (SELECT * REPLACE ({sig} AS sig) FROM kept WHERE n >= {least})", f"ready AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE 2.0 * (({sql.average_rank('round(sig, 12)')}) - 1) / (n - 1) - 1 END AS scaled FROM flat)"]


REGIMES = [
    "mkt AS (SELECT date, avg(fwd_ret_1) AS m FROM lab GROUP BY date)",
    "mk1 AS (SELECT date, CASE WHEN count(m) OVER w63 >= 40 THEN product(1 + m) OVER w63 - 1 END AS cum, CASE WHEN count(m) OVER w21 >= 10 THEN stddev_samp(m) OVER w21 END AS vol FROM mkt WINDOW w63 AS (ORDER BY date ROWS 62 PRECEDING), w21 AS (ORDER BY date ROWS 20 PRECEDING))",
    "mk2 AS (SELECT *, CASE WHEN count(vol) OVER w >= 40 THEN quantile_cont(vol, 0.5) OVER w END AS med, CASE WHEN count(vol) OVER w >= 40 THEN quantile_cont(vol, 0.6666666666666666) OVER w END AS top FROM mk1 WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))",
    "regimes AS (SELECT date, coalesce(cum > 0.05, false) AS bull, coalesce(cum < -0.05, false) AS bear, coalesce(vol <= med, false) AS calm, coalesce(vol > med, false) AS volatile, coalesce(vol >= top, false) AS highvol FROM mk2)",
]


@query("regime_labels", sql.query([*LAB[:2], *REGIMES], "SELECT * FROM regimes"))
def regime_labels(spark, sf_dir):
    return backtest.regime_labels(source.fwd_labels(source.panel(spark, sf_dir)))


_variant("bt_plain", backtest.Spec(), _ready())
_variant("bt_lag1", backtest.Spec(extra_lag=1), _ready(lag=1))
_variant("bt_cost15", backtest.Spec(cost_bps=15.0), _ready())
_variant("bt_horizon1", backtest.Spec(horizon=1), _ready())
_variant("bt_sector_neutral", backtest.Spec(neutralize=True), _ready("sig - avg(sig) OVER (PARTITION BY date, coalesce(sector, '__NA__'))"))
_variant("bt_year", backtest.Spec(subsample={"years": (1998,)}), _ready(where="year(date) = 1998"))
_variant("bt_exclude", backtest.Spec(subsample={"exclude_symbols": ("Brand#11", "Brand#12")}), _ready(where="symbol NOT IN ('Brand#11', 'Brand#12')"))
for _regime in ("bull", "bear", "calm", "volatile", "highvol"):
    _variant(f"bt_regime_{_regime}", backtest.Spec(subsample={"regime": _regime}), _ready(where=f"date IN (SELECT date FROM regimes WHERE {_regime})", more=tuple(REGIMES)))


_TERCILE = "CASE WHEN size_proxy IS NULL OR count(size_proxy) OVER (PARTITION BY date) < 3 THEN NULL WHEN 3 * (rank() OVER (PARTITION BY date ORDER BY size_proxy NULLS LAST) - 1) <= count(size_proxy) OVER (PARTITION BY date) - 1 THEN 'small' WHEN 3 * (rank() OVER (PARTITION BY date ORDER BY size_proxy NULLS LAST) - 1) <= 2 * (count(size_proxy) OVER (PARTITION BY date) - 1) THEN 'mid' ELSE 'large' END"
TURNOVER = "log(ts_mean(mul(close_raw, volume_raw), 21))"
LEAST_TURNOVER = 60_000.0
for _size in ("small", "mid", "large"):
    _variant(f"bt_size_{_size}", backtest.Spec(subsample={"size_tercile": _size}), _ready(where=f"(date, symbol) IN (SELECT (date, symbol) FROM (SELECT date, symbol, {_TERCILE} AS bucket FROM inside) WHERE bucket = '{_size}')", least=1))
_variant("bt_min_turnover", backtest.Spec(subsample={"min_turnover": LEAST_TURNOVER}), _ready(where=f"(date, symbol) IN (SELECT (date, symbol) FROM turnover_21 WHERE exp(turnover_21) >= {LEAST_TURNOVER})", more=(sql.formula(TURNOVER, "sig", "turnover_21", "t"),)), {"turnover_21": TURNOVER})


@query("holdout_purge", sql.query([*LAB, f"edge AS (SELECT min(pos) AS first FROM panel WHERE date >= DATE '{SPLITS.holdout_start}')"], f"SELECT purge, date, count(sig) AS n FROM sig CROSS JOIN (SELECT unnest([0, 5, 21]) AS purge) CROSS JOIN edge WHERE {sql.split('val_b')} AND pos + 1 + purge < coalesce(first, 1000000000) GROUP BY 1, 2 HAVING count(sig) >= {MIN_NAMES}"))
def holdout_purge(spark, sf_dir):
    """The days of the last split before the holdout that a purge of so many positions leaves."""
    rows = labelled(spark, sf_dir)
    kept = [backtest.prepare(rows, backtest.Spec("val_b", purge=k)).groupBy("date").agg(F.count("sig").alias("n")).select(F.lit(k).alias("purge"), "date", "n") for k in (0, 5, 21)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query("size_terciles", sql.query([sql.panel(), "t AS (SELECT date, symbol, size_proxy, rank() OVER (PARTITION BY date ORDER BY size_proxy NULLS LAST) - 1 AS k, count(size_proxy) OVER (PARTITION BY date) AS n FROM panel)"], "SELECT date, symbol, CASE WHEN size_proxy IS NULL OR n < 3 THEN NULL WHEN 3 * k <= n - 1 THEN 'small' WHEN 3 * k <= 2 * (n - 1) THEN 'mid' ELSE 'large' END AS bucket FROM t"))
def size_terciles(spark, sf_dir):
    return source.panel(spark, sf_dir).select("date", "symbol", stats.tercile(F.col("size_proxy"), "date").alias("bucket"))


@query("purge_embargo", sql.query([sql.panel(), f"cal AS (SELECT DISTINCT date, pos, {sql.split('val_a')} AS t FROM panel)", "runs AS (SELECT min(pos) AS a, max(pos) AS b FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM cal WHERE t) GROUP BY g)"], "SELECT date, CASE WHEN t THEN 'test' WHEN EXISTS (SELECT 1 FROM runs WHERE pos >= a - 6 AND pos < a) THEN 'purged' WHEN EXISTS (SELECT 1 FROM runs WHERE pos > b AND pos <= b + 5) THEN 'embargoed' ELSE 'train' END AS state FROM cal"))
def purge_embargo(spark, sf_dir):
    days = source.panel(spark, sf_dir).select("date", "pos").distinct()
    return backtest.purge_embargo(days, backtest.in_split("val_a"), 5, 5).select("date", "state")


# gates

FACTOR_CTES = [sql.formula(FACTORS["f1"], "sig", "f1", "g"), sql.formula(FACTORS["f2"], "f1", "f2", "h")]


def _ols(y: str, x: str, out: str, from_: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    a, b = f"(CASE WHEN {both} THEN {x} END)", f"(CASE WHEN {both} THEN {y} END)"
    slope = f"coalesce(covar_pop({a}, {b}) OVER {sql._D} / nullif(var_pop({a}) OVER {sql._D}, 0), 0)"
    return f"{out} AS (SELECT *, CASE WHEN {both} AND count({a}) OVER {sql._D} >= 3 THEN {y} - avg({b}) OVER {sql._D} - {slope} * ({x} - avg({a}) OVER {sql._D}) ELSE {y} END AS {out} FROM {from_})"


ORTHO1 = [*LAB, FACTOR_CTES[0], _ols("sig", "f1", "resid", "f1")]


@query("ortho_1f", sql.query(ORTHO1, "SELECT date, symbol, round(resid, 6) AS resid FROM resid"))
def ortho_1f(spark, sf_dir):
    rows = labelled(spark, sf_dir, extra={"f1": FACTORS["f1"]})
    return gates.orthogonalize(rows, "sig", ["f1"]).select("date", "symbol", r("resid").alias("resid"))


_JOINT = "joint AS (SELECT *, CASE WHEN sig IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL THEN 1 END AS j FROM f2)"
# normal equations of two factors, solved by Cramer's rule
_TWO = "two AS (SELECT *, covar_pop(y, a) OVER d AS ya, covar_pop(y, b) OVER d AS yb, covar_pop(a, b) OVER d AS ab, var_pop(a) OVER d AS aa, var_pop(b) OVER d AS bb, avg(y) OVER d AS my, avg(a) OVER d AS ma, avg(b) OVER d AS mb, count(j) OVER d AS n FROM (SELECT *, CASE WHEN j = 1 THEN sig END AS y, CASE WHEN j = 1 THEN f1 END AS a, CASE WHEN j = 1 THEN f2 END AS b FROM joint) WINDOW d AS (PARTITION BY date))"


@query("ortho_2f", sql.query([*LAB, *FACTOR_CTES, _JOINT, _TWO], "SELECT date, symbol, round(CASE WHEN j = 1 AND n >= 4 THEN y - my - (ya * bb - yb * ab) / (aa * bb - ab * ab) * (a - ma) - (yb * aa - ya * ab) / (aa * bb - ab * ab) * (b - mb) ELSE sig END, 6) AS resid FROM two"))
def ortho_2f(spark, sf_dir):
    return gates.orthogonalize(labelled(spark, sf_dir, extra=FACTORS), "sig", ["f1", "f2"]).select("date", "symbol", r("resid").alias("resid"))


@query("marginal_ic", sql.query([*ORTHO1, ic_cte("resid", "fwd_ret_5_demeaned", "resid", least=MIN_NAMES), ic_cte("sig", "fwd_ret_5_demeaned", "resid", out="raw", least=MIN_NAMES)], "SELECT round(avg(ic), 6) AS marginal_ic, round(avg(ic) * sqrt(count(*)) / stddev_samp(ic), 6) AS t_stat, count(*) AS n_days, CASE WHEN avg(ic) > 0 THEN 1 ELSE -1 END AS sign, (SELECT round(avg(ic), 6) FROM raw) AS raw_ic FROM ics"))
def marginal_ic(spark, sf_dir):
    return summary(gates.marginal_ic(labelled(spark, sf_dir, extra={"f1": FACTORS["f1"]}), "sig", ["f1"], "fwd_ret_5_demeaned"))


@query("walk_forward", sql.query([*LAB, ic_cte("sig", "fwd_ret_5_demeaned", "sig", least=MIN_NAMES), "folds AS (SELECT CAST(k AS INTEGER) AS fold, CAST(DATE '1997-01-01' + INTERVAL (k * 6) MONTH AS DATE) AS s, CAST(least(DATE '1997-01-01' + INTERVAL (k * 6 + 6) MONTH - INTERVAL 1 DAY, DATE '2000-12-31') AS DATE) AS e FROM range(8) t(k))", "numbered AS (SELECT fold, ic, row_number() OVER (PARTITION BY fold ORDER BY date) AS i FROM ics JOIN folds ON date BETWEEN s AND e)"], "SELECT fold, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic), 6) AS ir, round(avg(ic) * sqrt(count(*)) / stddev_samp(ic), 6) AS t_stat, count(*) AS n_days FROM numbered WHERE i > 10 GROUP BY fold"))
def walk_forward(spark, sf_dir):
    ics = stats.daily_ic(labelled(spark, sf_dir), "sig", "fwd_ret_5_demeaned", least=MIN_NAMES)
    return summary(gates.walk_forward(ics, gates.folds(spark, "1995-01-01", "2000-12-31", 2, 6), 10))


_STRATEGIES = "strat AS (SELECT symbol AS strategy, CAST(pos - 1 AS BIGINT) AS t, coalesce(returns, 0) AS r FROM panel WHERE pos BETWEEN 1 AND (SELECT max(pos) // 8 * 8 FROM panel))"
_CSCV = [
    sql.panel(), _STRATEGIES,
    "st AS (SELECT CAST(floor(t * 8 / (SELECT max(t) + 1 FROM strat)) AS INTEGER) AS block, strategy, count(*) AS n, sum(r) AS s1, sum(r * r) AS s2 FROM strat GROUP BY 1, 2)",
    "masks AS (SELECT m FROM range(256) t(m) WHERE bit_count(m) = 4)",
    "half AS (SELECT m, (m >> block) & 1 = 1 AS inside, strategy, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2 FROM st CROSS JOIN masks GROUP BY 1, 2, 3)",
    "sr AS (SELECT *, coalesce(s1 / n / nullif(sqrt(greatest((s2 - n * (s1 / n) * (s1 / n)) / (n - 1), 0)), 0), 0) AS v FROM half)",
    "best AS (SELECT m, strategy FROM (SELECT m, strategy, row_number() OVER (PARTITION BY m ORDER BY v DESC, strategy DESC) AS k FROM sr WHERE inside) WHERE k = 1)",
    "oos AS (SELECT m, strategy, (rank() OVER (PARTITION BY m ORDER BY v) + (count(*) OVER (PARTITION BY m, v) - 1) / 2.0) / (count(*) OVER (PARTITION BY m) + 1) AS p FROM sr WHERE NOT inside)",
]


@query("cscv_pbo", sql.query(_CSCV, "SELECT round(avg(CASE WHEN ln(p / (1 - p)) < 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo, count(*) AS n_splits FROM best JOIN oos USING (m, strategy)"))
def cscv_pbo(spark, sf_dir):
    rows = source.panel(spark, sf_dir).where("pos >= 1").select(F.col("symbol").alias("strategy"), (F.col("pos") - 1).cast("long").alias("t"), F.coalesce("returns", F.lit(0.0)).alias("r"))
    return summary(gates.pbo(rows))


DRAWS, DRAWN = 30, 12
_DRAWS = [
    sql.panel(),
    f"picks AS (SELECT draw, symbol FROM (SELECT CAST(draw AS INTEGER) AS draw, symbol, row_number() OVER (PARTITION BY draw ORDER BY md5('draw|' || draw || '|' || symbol), symbol) AS k FROM (SELECT DISTINCT symbol FROM panel) CROSS JOIN range({DRAWS}) d(draw)) WHERE k <= {DRAWN})",
    "strat AS (SELECT draw, symbol AS strategy, CAST(pos - 1 AS BIGINT) AS t, coalesce(returns, 0) AS r FROM panel JOIN picks USING (symbol) WHERE pos BETWEEN 1 AND (SELECT max(pos) // 8 * 8 FROM panel))",
    "st AS (SELECT draw, CAST(floor(t * 8 / (SELECT max(t) + 1 FROM strat)) AS INTEGER) AS block, strategy, count(*) AS n, sum(r) AS s1, sum(r * r) AS s2 FROM strat GROUP BY 1, 2, 3)",
    _CSCV[3],
    "half AS (SELECT draw, m, (m >> block) & 1 = 1 AS inside, strategy, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2 FROM st CROSS JOIN masks GROUP BY 1, 2, 3, 4)",
    _CSCV[5],
    "best AS (SELECT draw, m, strategy FROM (SELECT draw, m, strategy, row_number() OVER (PARTITION BY draw, m ORDER BY v DESC, strategy DESC) AS k FROM sr WHERE inside) WHERE k = 1)",
    "oos AS (SELECT draw, m, strategy, (rank() OVER (PARTITION BY draw, m ORDER BY v) + (count(*) OVER (PARTITION BY draw, m, v) - 1) / 2.0) / (count(*) OVER (PARTITION BY draw, m) + 1) AS p FROM sr WHERE NOT inside)",
]


@query("pbo_draws", sql.query(_DRAWS, "SELECT draw, round(avg(CASE WHEN ln(p / (1 - p)) < 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo, count(*) AS n_splits FROM best JOIN oos USING (draw, m, strategy) GROUP BY 1"))
def pbo_draws(spark, sf_dir):
    """How much the overfitting probability moves with the choice of names: thirty draws of twelve, all in one plan."""
    rows = source.panel(spark, sf_dir)
    returns = rows.where("pos >= 1").join(gates.drawn(rows, DRAWS, DRAWN), "symbol").select("draw", F.col("symbol").alias("strategy"), (F.col("pos") - 1).cast("long").alias("t"), F.coalesce("returns", F.lit(0.0)).alias("r"))
    return summary(gates.pbo(returns, keys=("draw",)))


SERIES = ["alpha101_003", "alpha101_006", "alpha101_012", "classical_short_term_reversal", "classical_low_volatility", "classical_volume_shock"]


def _series_sql() -> list[str]:
    parts, last = LAB[:2], "lab"
    for k in SERIES:
        parts.append(sql.formula(ZOO[k], last, k, f"q{k[-6:]}".replace(".", "")))
        last = k
    parts.append("series AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, date, {last}.{k} AS sig, fwd_ret_5_demeaned FROM {last}" for k in SERIES) + ")")
    return [*parts, ic_cte("sig", "fwd_ret_5_demeaned", "series", keys="name, date", least=MIN_NAMES)]


def series_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, date, ic of several formulas, scored in one plan."""
    rows = source.fwd_labels(source.panel(spark, sf_dir))
    wide = evaluate(rows, {k: ZOO[k] for k in SERIES}, ("date", "symbol", "fwd_ret_5_demeaned"))
    long = wide.select("date", "fwd_ret_5_demeaned", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("sig")) for k in SERIES))).alias("x")).select("date", "fwd_ret_5_demeaned", "x.name", "x.sig")
    return stats.daily_ic(long, "sig", "fwd_ret_5_demeaned", least=MIN_NAMES, keys=("name", "date"))


_CORR = "corr AS (SELECT x.name AS a, y.name AS b, covar_samp(x.ic, y.ic) / nullif(stddev_samp(x.ic) * stddev_samp(y.ic), 0) AS c FROM ics x JOIN ics y ON x.date = y.date GROUP BY 1, 2)"


@query("corr_matrix", sql.query([*_series_sql(), _CORR], "SELECT a, b, round(c, 6) AS corr FROM corr"))
def corr_matrix(spark, sf_dir):
    return summary(gates.pair_corr(series_ics(spark, sf_dir), "date", "name", "ic", SERIES))


@query("effective_n", sql.query([*_series_sql(), _CORR], "SELECT round(count(DISTINCT a) * count(DISTINCT a) / sum(c * c), 6) AS effective_n FROM corr"))
def effective_n(spark, sf_dir):
    return summary(gates.participation(gates.pair_corr(series_ics(spark, sf_dir), "date", "name", "ic", SERIES)))


_WEIGHTS = "weights AS (SELECT a AS name, (1 / (avg(abs(c)) + 1e-6)) / sum(1 / (avg(abs(c)) + 1e-6)) OVER () AS weight FROM corr WHERE a <> b GROUP BY a)"


def inverse_corr(corr: DataFrame) -> DataFrame:
    """Weights in inverse proportion to the mean absolute correlation with the others."""
    raw = corr.where("a <> b").groupBy(F.col("a").alias("name")).agg((1 / (F.avg(F.abs("corr")) + 1e-6)).alias("_w"))
    return raw.crossJoin(raw.agg(F.sum("_w").alias("_all"))).select("name", (F.col("_w") / F.col("_all")).alias("weight"))


@query("inv_corr_weights", sql.query([*_series_sql(), _CORR, _WEIGHTS], "SELECT name, round(weight, 6) AS weight FROM weights"))
def inv_corr_weights(spark, sf_dir):
    return summary(inverse_corr(gates.pair_corr(series_ics(spark, sf_dir), "date", "name", "ic", SERIES)))


@query("portfolio_combine", sql.query([*_series_sql(), _CORR, _WEIGHTS], "SELECT name, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic), 6) AS icir, count(*) AS n FROM (SELECT name, date, ic FROM ics UNION ALL SELECT 'combined', date, sum(ic * weight) FROM ics JOIN weights USING (name) GROUP BY date) GROUP BY name"))
def portfolio_combine(spark, sf_dir):
    ics = series_ics(spark, sf_dir)
    weights = inverse_corr(gates.pair_corr(ics, "date", "name", "ic", SERIES))
    both = ics.select("name", "date", "ic").unionByName(ics.join(weights, "name").groupBy("date").agg(F.sum(F.col("ic") * F.col("weight")).alias("ic")).withColumn("name", F.lit("combined")))
    return both.groupBy("name").agg(r(F.avg("ic")).alias("mean_ic"), r(F.try_divide(F.avg("ic"), F.stddev_samp("ic"))).alias("icir"), F.count("*").alias("n"))


@query("regime_weights", sql.query([*_series_sql(), *REGIMES, "tagged AS (SELECT name, CASE WHEN bull THEN 'bull' WHEN bear THEN 'bear' ELSE 'flat' END AS regime, ic FROM ics JOIN regimes USING (date))"], "SELECT regime, name, round(avg(ic), 6) AS mean_ic, count(*) AS n FROM tagged GROUP BY 1, 2 HAVING count(*) >= 30"))
def regime_weights(spark, sf_dir):
    tag = F.when(F.col("bull"), "bull").when(F.col("bear"), "bear").otherwise("flat")
    tagged = series_ics(spark, sf_dir).join(regime_labels(spark, sf_dir), "date").withColumn("regime", tag)
    return summary(tagged.groupBy("regime", "name").agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n")).where("n >= 30"))


@query("ic_moments", sql.query([*_series_sql()], "SELECT name, count(*) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS sd, round(skewness(ic), 4) AS skew, round(kurtosis(ic) + 3, 4) AS kurt FROM ics GROUP BY name"))
def ic_moments(spark, sf_dir):
    m = stats.moments(series_ics(spark, sf_dir), "ic", "name")
    return m.select("name", "n", r("mean").alias("mean"), r("sd").alias("sd"), r("skew", 4).alias("skew"), r("kurt", 4).alias("kurt"))


def _board_sql() -> str:
    parts, last = LAB[:2], "lab"
    for i, k in enumerate(ZOO):
        parts.append(sql.formula(ZOO[k], last, k, f"z{i}"))
        last = k
    parts.append("board AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, date, round({last}.{k}, 12) AS sig, fwd_ret_5_demeaned FROM {last} WHERE {TRAIN}" for k in ZOO) + ")")
    parts.append(ic_cte("sig", "fwd_ret_5_demeaned", "board", keys="name, date", least=MIN_NAMES))
    return sql.query(parts, "SELECT n.name, round(avg(ic), 6) AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir, round(avg(ic) * sqrt(count(ic)) / nullif(stddev_samp(ic), 0), 6) AS t_stat, count(ic) AS n_days FROM (SELECT DISTINCT name FROM board) n LEFT JOIN ics USING (name) GROUP BY n.name")


@query("zoo_leaderboard", _board_sql())
def zoo_leaderboard(spark, sf_dir):
    """Every known formula scored in one plan: name, mean_ic, icir, t_stat, n_days; best first. Values that agree to twelve decimals tie, as in rank."""
    rows = source.fwd_labels(source.panel(spark, sf_dir))
    wide = evaluate(rows, ZOO, ("date", "symbol", "fwd_ret_5_demeaned")).where(backtest.in_split("val_a"))
    long = wide.select("date", "fwd_ret_5_demeaned", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.round(F.col(k), 12).alias("sig")) for k in ZOO))).alias("x")).select("date", "fwd_ret_5_demeaned", "x.name", "x.sig")
    ics = stats.daily_ic(long, "sig", "fwd_ret_5_demeaned", least=MIN_NAMES, keys=("name", "date"))
    names = spark.createDataFrame([(k,) for k in ZOO], "name string")
    out = names.join(stats.ic_summary(ics, "name"), "name", "left")
    return out.select("name", r("mean_ic").alias("mean_ic"), r("icir").alias("icir"), r("t_stat").alias("t_stat"), F.coalesce("n_days", F.lit(0)).alias("n_days")).orderBy(F.desc_nulls_last("mean_ic"), "name")
