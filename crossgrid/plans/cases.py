"""Case studies: what a formula seems worth when its data are wrong, beside what it is worth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_NAMES
from ..functions import stats
from ..sources import panel as source
from ..sources.staging import staged
from . import backtest, catalog, redteam, universe
from .formula import with_formulas

FORMULA, LEAST = "rank(mul(-1, delta(close, 1)))", 5


def broken_universe(rows: DataFrame, selected: DataFrame, formula: str = FORMULA, horizon: int = 1, least: int = LEAST) -> DataFrame:
    """universe, n_days, mean_ic, icir, t_stat, market: one formula on each month's own selection (point_in_time) and on the last one applied to all days (as_supplied), with labels less the members' mean and the mean return of members.

    The second knows which names will last: its market, and often its scores, are those of survivors."""
    ret = F.col(f"fwd_ret_{horizon}")
    # made once, as are the members' rows: labels don't depend on the universe, only their mean does
    scored = staged(with_formulas(source.fwd_labels(rows, (horizon,)), {"sig": formula}).select("date", "symbol", F.round("sig", 12).alias("sig"), ret.alias("ret")))
    selected = staged(selected.select("month_end", "symbol"))
    last = selected.agg(F.max("month_end").alias("_last"))
    kept = selected.crossJoin(last).where("month_end = _last").select("symbol", F.lit(None).cast("date").alias("until")).crossJoin(scored.agg(F.date_sub(F.min("date"), 1).alias("after")))
    out = []
    for name, runs in (("point_in_time", universe.member_runs(selected)), ("as_supplied", kept)):
        marked = universe.mark_members(scored, runs).where("in_universe")
        out.append(marked.select(F.lit(name).alias("universe"), "date", "sig", "ret", (F.col("ret") - F.avg("ret").over(Window.partitionBy("date"))).alias("y")))
    both = staged(reduce(DataFrame.unionByName, out))
    ics = stats.ic_summary(stats.daily_ic(both, "sig", "y", least=least, keys=("universe", "date")), "universe")
    market = both.groupBy("universe", "date").agg(F.avg("ret").alias("m")).groupBy("universe").agg(F.avg("m").alias("market"))
    return ics.join(market, "universe").select("universe", "n_days", "mean_ic", "icir", "t_stat", "market")


def leak(rows: DataFrame, formula: str, split: str = "val_a", label: str = "fwd_ret_1_demeaned", least: int = MIN_NAMES) -> DataFrame:
    """signal, mean_ic, t_stat, lagged_ic, lagged_t, flagged: a formula, a signal of 85 parts of its own label and 15 of noise, and the noise, each as it is and a day late. What knows the future looks best, and collapses when it comes late."""
    noisy = catalog.noise("leak")
    scored = with_formulas(rows, {"clean": formula}).withColumns({"leak": 0.85 * F.coalesce(label, F.lit(0.0)) + 0.15 * 0.05 * noisy, "noise": noisy})
    w = Window.partitionBy("symbol").orderBy("pos")
    names = ("clean", "leak", "noise")
    late = scored.withColumns({f"{n}_late": F.lag(n, 1).over(w) for n in names}).where(backtest.in_split(split))
    tags = [F.struct(F.lit(n).alias("signal"), F.lit(k).alias("late"), F.round(c, 12).alias("s")) for n in names for k, c in ((False, F.col(n)), (True, F.col(f"{n}_late")))]
    long = late.select("date", F.col(label).alias("y"), F.explode(F.array(*tags)).alias("x")).select("date", "y", "x.signal", "x.late", "x.s")
    ics = stats.ic_summary(stats.daily_ic(long, "s", "y", least=least, keys=("signal", "late", "date")), "signal", "late")
    of = lambda late_, c: F.max(F.when(F.col("late") == F.lit(late_), F.col(c)))
    wide = ics.groupBy("signal").agg(of(False, "mean_ic").alias("mean_ic"), of(False, "t_stat").alias("t_stat"), of(True, "mean_ic").alias("lagged_ic"), of(True, "t_stat").alias("lagged_t"))
    base, lag = F.col("mean_ic"), F.col("lagged_ic")
    flag = (lag <= 0) | ((base > 0) & (lag < redteam.COLLAPSE * base)) | (F.abs("lagged_t") < redteam.WEAK_T)
    return wide.withColumn("flagged", F.coalesce(flag, F.lit(True)))


def signs(ics: DataFrame, claims: DataFrame) -> DataFrame:
    """name, claimed, realized, agrees: of claims (name, claimed: -1, 0 or 1) against mean ICs (name, date, ic). A claim of 0, or without a score, agrees with nothing."""
    real = ics.groupBy("name").agg(F.when(F.avg("ic") > 0, 1).otherwise(-1).alias("realized"))
    return claims.join(real, "name", "left").select("name", "claimed", "realized", F.coalesce((F.col("claimed") == F.col("realized")) & (F.col("claimed") != 0), F.lit(False)).alias("agrees"))


def register() -> None:
    from ..oracles import sql
    from .queries import LAB, SERIES, SIGNAL, _series_sql, ic_cte, query, r, series_ics, summary
    from .reports import MEMBERS, RANKS, TOP, W, HIST, _bars

    sets = "u AS (SELECT 'point_in_time' AS universe, date, symbol FROM members UNION ALL SELECT 'as_supplied', d.date, c.symbol FROM (SELECT DISTINCT date FROM panel) d CROSS JOIN (SELECT symbol FROM chosen WHERE month_end = (SELECT max(month_end) FROM chosen)) c)"
    labels = "fwd AS (SELECT *, lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS ret FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY pos))"
    marked = "x AS (SELECT universe, date, round(sig, 12) AS s, ret, ret - avg(ret) OVER (PARTITION BY universe, date) AS y FROM u JOIN fwd USING (date, symbol))"

    @query("case_broken_universe", sql.query([*MEMBERS, sql.formula(FORMULA), sets, labels, marked, ic_cte("s", "y", "x", keys="universe, date", least=LEAST), "mk AS (SELECT universe, avg(m) AS market FROM (SELECT universe, date, avg(ret) AS m FROM x GROUP BY 1, 2) GROUP BY 1)"], "SELECT universe, count(*) AS n_days, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(ic) * sqrt(count(*)) / stddev_samp(ic), 6) AS t_stat, round(any_value(market), 6) AS market FROM ics JOIN mk USING (universe) GROUP BY 1"))
    def case_broken_universe(spark, sf_dir):
        bars = staged(_bars(spark, sf_dir).select("date", "symbol", "sector", "open", "close", "volume"))
        return summary(broken_universe(source.panel_of(bars), universe.select(universe.liquidity_ranks(bars, W, HIST), TOP)))

    @query("universe_mask", sql.query([*MEMBERS], "SELECT date, count(*) AS n_names, count(m.symbol) AS n_members, round(avg(CASE WHEN m.symbol IS NOT NULL THEN p.returns END), 6) AS market FROM panel p LEFT JOIN members m USING (date, symbol) GROUP BY date"))
    def universe_mask(spark, sf_dir):
        """The market's return within the universe, by the runs of membership."""
        bars = staged(_bars(spark, sf_dir).select("date", "symbol", "sector", "close", "volume"))
        selected = staged(universe.select(universe.liquidity_ranks(bars, W, HIST), TOP).select("month_end", "symbol"))
        rows = universe.mark_members(source.panel_of(bars), universe.member_runs(selected))
        return rows.groupBy("date").agg(F.count("*").alias("n_names"), F.count_if("in_universe").alias("n_members"), r(F.avg(F.when(F.col("in_universe"), F.col("returns")))).alias("market"))

    @query("selection_check", sql.query(RANKS, "SELECT month_end AS cut, 'whole' AS side, month_end, symbol, liquidity_rank FROM ranks WHERE false"))
    def selection_check(spark, sf_dir):
        """Rows by which a month's ranks change if the history ends there: none, or the ranks look ahead."""
        ranks = lambda rows: universe.liquidity_ranks(rows, W, HIST).select("month_end", "symbol", "liquidity_rank")
        return universe.selection_differences(staged(_bars(spark, sf_dir).select("date", "symbol", "close", "volume")), ranks, ["1996-06-01", "1998-01-01", "2000-03-01"])

    noisy = "(CAST('0x' || substr(md5('leak|' || CAST(date AS VARCHAR) || '|' || symbol), 1, 8) AS BIGINT) / 4294967296.0 - 0.5)"
    named = {"clean": "sig", "leak": f"0.85 * coalesce(fwd_ret_1_demeaned, 0) + 0.15 * 0.05 * {noisy}", "noise": noisy}
    leaks = [
        *LAB, "v AS (SELECT *, " + ", ".join(f"{x} AS s_{n}" for n, x in named.items()) + " FROM sig)", "v2 AS (SELECT *, " + ", ".join(f"lag(s_{n}) OVER (PARTITION BY symbol ORDER BY pos) AS l_{n}" for n in named) + " FROM v)",
        "long AS (" + " UNION ALL ".join(f"SELECT date, '{n}' AS signal, {late} AS late, round({k}_{n}, 12) AS s, fwd_ret_1_demeaned AS y FROM v2 WHERE {sql.split('val_a')}" for n in named for k, late in (("s", "false"), ("l", "true"))) + ")",
        ic_cte("s", "y", "long", keys="signal, late, date", least=MIN_NAMES), "m AS (SELECT signal, late, avg(ic) AS m, avg(ic) * sqrt(count(*)) / stddev_samp(ic) AS t FROM ics GROUP BY 1, 2)",
        "w AS (SELECT signal, max(m) FILTER (NOT late) AS mean_ic, max(t) FILTER (NOT late) AS t_stat, max(m) FILTER (late) AS lagged_ic, max(t) FILTER (late) AS lagged_t FROM m GROUP BY 1)",
    ]

    @query("case_leak", sql.query(leaks, f"SELECT signal, round(mean_ic, 6) AS mean_ic, round(t_stat, 6) AS t_stat, round(lagged_ic, 6) AS lagged_ic, round(lagged_t, 6) AS lagged_t, lagged_ic <= 0 OR (mean_ic > 0 AND lagged_ic < {redteam.COLLAPSE} * mean_ic) OR abs(lagged_t) < {redteam.WEAK_T} AS flagged FROM w"))
    def case_leak(spark, sf_dir):
        return summary(leak(source.fwd_labels(source.panel(spark, sf_dir)), SIGNAL))

    claimed = {n: (1, -1, 0)[k % 3] for k, n in enumerate(SERIES)}

    @query("sign_check", sql.query(_series_sql(), "SELECT name, claimed, realized, claimed = realized AND claimed <> 0 AS agrees FROM (SELECT name, CASE WHEN avg(ic) > 0 THEN 1 ELSE -1 END AS realized FROM ics GROUP BY 1) JOIN (VALUES " + ", ".join(f"('{n}', {c})" for n, c in claimed.items()) + ") t(name, claimed) USING (name)"))
    def sign_check(spark, sf_dir):
        return signs(series_ics(spark, sf_dir), spark.createDataFrame(list(claimed.items()), "name string, claimed int"))
